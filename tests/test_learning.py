"""Clustering against plain DBSCAN, forests, models, intel."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracehold.operators import density, intel, models
from tracehold.operators.density import DensityModel, connected_components, dbscan_anomalies
from tracehold.operators.features import FeatureModel, fit_features
from tracehold.operators.forest import IsolationForest, isolation_forest_anomalies
from tracehold.plans.intelligence import AS_OF
from tracehold.session import stage
from tracehold.sources.evidence import evidence_manifest, verify_manifest
from tracehold.sources.feeds import feed_lines, read_attack_catalog, read_feed, FEEDS


def plain_dbscan(x, eps, minimum, extra=None):
    """Labels as the textbook gives them: clusters in order of their first core point."""
    d2 = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    if extra is not None:
        d2 = d2 + extra
    near = d2 <= eps * eps
    core = near.sum(1) >= minimum
    label = np.full(len(x), -1)
    current = 0
    for i in range(len(x)):
        if not core[i] or label[i] >= 0:
            continue
        label[i], todo = current, [i]
        while todo:
            j = todo.pop()
            if not core[j]:
                continue
            for k in np.flatnonzero(near[j]):
                if label[k] < 0:
                    label[k] = current
                    todo.append(k)
        current += 1
    return label


def blobs(seed, n, dims, spread):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-3, 3, (5, dims))
    x = centres[rng.integers(0, 5, n)] + rng.normal(0, spread, (n, dims))
    x[: n // 3] = np.round(x[: n // 3], 1)  # copies
    return x


@pytest.mark.parametrize("seed,dims,eps,minimum", [(1, 1, 0.05, 4), (2, 2, 0.3, 5), (3, 2, 0.15, 12), (4, 3, 0.5, 6), (5, 2, 0.05, 3), (6, 6, 1.0, 4)])
def test_clusters_like_plain_dbscan(spark, seed, dims, eps, minimum):
    x = blobs(seed, 260, dims, 0.3)
    want = plain_dbscan(x, eps, minimum)
    points = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"x{i} double" for i in range(dims)))
    model = DensityModel(points, "id", dims, eps, minimum)
    assert sorted(r.id for r in model.noise().collect()) == list(np.flatnonzero(want < 0))
    got = np.array([r.cluster for r in model.clusters().orderBy("id").collect()])
    assert list(got) == list(want)


@pytest.mark.parametrize("eps", [0.4, 1.2])
def test_clusters_with_categories(spark, eps):
    x = blobs(9, 150, 2, 0.4)
    kind = np.random.default_rng(9).choice(["", "p", "q"], len(x))
    differ = kind[:, None] != kind[None, :]
    base = (kind[:, None] == "") | (kind[None, :] == "")
    want = plain_dbscan(x, eps, 5, np.where(differ, np.where(base, 1.0, 2.0), 0.0))
    points = spark.createDataFrame([(i, float(a), float(b), [k]) for i, ((a, b), k) in enumerate(zip(x, kind))], "id long, x0 double, x1 double, cats array<string>")
    got = DensityModel(points, "id", 2, eps, 5, True).clusters().orderBy("id").collect()
    assert [r.cluster for r in got] == list(want)


def salted_joins(df, capsys):
    """The joins of a plan that run on salted copies."""
    capsys.readouterr()
    df.explain()
    return [line for line in capsys.readouterr().out.splitlines() if "Join" in line and "_salt" in line]


@pytest.mark.parametrize("cats", [True, False])
def test_points_are_not_broadcast(spark, monkeypatch, capsys, cats):
    """The driver must not hold salted copies of cells or points, which compress to small files."""
    joins = []

    def watched(df, label):
        joins.extend(salted_joins(df, capsys))
        return stage(df, label)

    monkeypatch.setattr(density, "stage", watched)
    points = spark.createDataFrame([(i, i % 9 / 10, i % 7 / 10, ["p"]) for i in range(90)], "id long, x0 double, x1 double, cats array<string>")
    points = points if cats else points.drop("cats")
    joins += salted_joins(DensityModel(points, "id", 2, 0.3, 5, cats).clusters(), capsys)
    assert len(joins) > 2 and not any("Broadcast" in line for line in joins)


def joins_of(df, capsys, keys):
    """The joins of a plan with one of ``keys`` in their line."""
    capsys.readouterr()
    df.explain()
    return [line for line in capsys.readouterr().out.splitlines() if "Join" in line and any(k in line for k in keys)]


def test_rows_are_not_broadcast(spark, monkeypatch, capsys):
    """Nor points, boxes and rows of the table where they are joined without copies."""
    joins = []

    def watched(df, label):
        joins.extend(joins_of(df, capsys, ["slice#", "a_parent", "o_x0", "[a_x0"]))
        return stage(df, label)

    monkeypatch.setattr(density, "stage", watched)
    rows = [(i, float(i % 40), float(i * i % 97)) for i in range(400)]
    points = spark.createDataFrame(rows, "id long, x double, y double")
    found = stage(models.cluster_events(points, "id", ["x", "y"], eps=0.3, min_samples=5), "clusters")
    assert joins and not any("Broadcast" in line for line in joins)
    for df in (models.cluster_stats(points, found, "id", ["x"]), models.cluster_categories(points, found, "id", "x")):
        joins = joins_of(df, capsys, ["id#"])
        assert joins and not any("Broadcast" in line for line in joins)


def test_dense_cells_touching_at_a_corner(spark):
    """Two crowded cells whose only near pair sits at their corner: boxes must be refined."""
    rng = np.random.default_rng(3)
    a, b = rng.uniform(0, 0.6, (200, 2)), rng.uniform(0, 0.6, (200, 2)) + 1.3
    a[0], b[0] = [0.95, 0.95], [1.28, 1.28]
    x = np.vstack([a, b])
    for eps in (0.46, 0.47):
        want = plain_dbscan(x, eps, 3)
        points = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, x0 double, x1 double")
        got = DensityModel(points, "id", 2, eps, 3).clusters().orderBy("id").collect()
        assert [r.cluster for r in got] == list(want)


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 300)]
    nodes = sorted({n for e in edges for n in e} | {999})
    node_df = spark.createDataFrame([(n,) for n in nodes], "node long")
    got = {r.node: r.component for r in connected_components(node_df, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: 0 if n <= 40 else 100 if n < 200 else 200 if n <= 300 else 999 for n in nodes}


def test_dbscan_fills_missing_values(spark):
    rows = [(i, float(i % 10)) for i in range(200)] + [(200, None), (201, 500.0)]
    df = spark.createDataFrame(rows, "id long, v double")
    assert [r.id for r in dbscan_anomalies(df, ["v"], "id").collect()] == [201]


def test_forest_finds_planted_outliers(spark):
    rng = np.random.default_rng(0)
    rows = [(i, *map(float, rng.normal(0, 1, 2))) for i in range(1000)] + [(5000 + i, 40.0 + i, -40.0 - i) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    found = {r.id for r in isolation_forest_anomalies(df, ["a", "b"], "id", contamination=0.02).collect()}
    assert {5000 + i for i in range(10)} <= found and 15 <= len(found) <= 21


def test_models_roundtrip(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.normal(i % 2 * 5, 1)), "ab"[i % 2], "good" if i % 2 else "bad", None if i % 7 == 0 else float(i % 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v double, c string, label string, w double")
    path = str(tmp_path / "models")
    clf = models.train_classifier(df, "label", ["v", "w"], ["c"], trees=10)
    models.save_model(spark, clf, path, "clf")
    forest = models.train_anomaly_model(df, "id", ["v"], ["c"], ["label"])
    models.save_model(spark, forest, path, "forest")
    assert {(r.name, r.type) for r in models.list_models(spark, path).collect()} == {("clf", "random_forest"), ("forest", "isolation_forest")}
    scored = models.load_model(spark, path, "clf").transform(df)
    assert scored.where("predicted_class = label").count() > 390
    assert scored.where(F.abs(F.col("prob_good") + F.col("prob_bad") - 1) > 1e-6).count() == 0
    a = forest.transform(df).select("id", "anomaly_score").orderBy("id").collect()
    b = models.load_model(spark, path, "forest").transform(df).select("id", "anomaly_score").orderBy("id").collect()
    assert [x.anomaly_score for x in a] == pytest.approx([x.anomaly_score for x in b])
    with pytest.raises(FileNotFoundError):
        models.load_model(spark, path, "nothing")
    assert clf.config["class_distribution"] == {"good": 200, "bad": 200}
    assert max(clf.importances(), key=clf.importances().get) in ("v", "c_b")


def test_features_use_fitted_values(spark):
    train = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, None)], "x double, c string")
    model = FeatureModel.from_json(fit_features(train, ["x"], ["c"]).to_json())
    new = spark.createDataFrame([(2.0, "b"), (None, "zzz")], "x double, c string")
    assert [list(r.features) for r in model.transform(new).collect()] == [[0.0, 1.0], [0.0, 0.0]]
    with pytest.raises(ValueError):
        fit_features(train)


@pytest.mark.parametrize(
    "text,kind",
    [
        ("1.2.3.4", "ipv4"), ("1.2.3.256", "unknown"), ("01.2.3.4", "unknown"), ("::", "ipv6"), ("::1", "ipv6"), ("fe80::1%eth0", "ipv6"),
        ("::ffff:1.2.3.4", "ipv6"), ("1:2:3:4:5:6:7:8", "ipv6"), ("1:2:3:4:5:6:7", "unknown"), ("1::2::3", "unknown"), ("12345::", "unknown"), ("1:2:3:4:5:6:7::", "ipv6"),
        ("a.example.com", "domain"), ("http://x.y/z", "url"), ("d" * 32, "md5"), ("d" * 40, "sha1"), ("d" * 64, "sha256"), ("d" * 33, "unknown"),
    ],
)
def test_indicator_types(spark, text, kind):
    assert spark.range(1).select(intel.indicator_type(F.lit(text))).first()[0] == kind


def test_feeds(spark, tmp_path):
    (tmp_path / "ips.txt").write_text("# c\n\n1.2.3.4\n 5.6.7.8 \n")
    assert [r.indicator for r in read_feed(spark, "abuse_ch_feodo", str(tmp_path / "ips.txt")).collect()] == ["1.2.3.4", "5.6.7.8"]
    (tmp_path / "drop.txt").write_text("; c\n1.0.0.0/8 ; SBL1\n")
    assert read_feed(spark, "spamhaus_drop", str(tmp_path / "drop.txt")).count() == 1
    (tmp_path / "misp.json").write_text(json.dumps({"list": ["a.com", "b.com"]}, indent=1))
    assert read_feed(spark, "misp_warning_list", str(tmp_path / "misp.json")).count() == 2
    (tmp_path / "phish.json").write_text(json.dumps([{"url": "http://a.com/x"}, {"id": 1}]))
    assert read_feed(spark, "phishtank", str(tmp_path / "phish.json")).count() == 1
    (tmp_path / "otx.json").write_text(json.dumps({"results": [{"indicators": {"ip": ["1.1.1.1"], "domain": ["c.com", "http://d.com/e"]}}]}))
    (tmp_path / "fox.json").write_text(json.dumps({"data": {"iocs": [{"ioc": "1.1.1.1"}, {"other": 1}]}}, indent=1))
    assert read_feed(spark, "threatfox", str(tmp_path / "fox.json")).count() == 1
    mixed = intel.classify_feed(read_feed(spark, "alienvault_otx", str(tmp_path / "otx.json")), "mixed")
    assert sorted((r.type, r.indicator) for r in mixed.collect()) == [("domain", "c.com"), ("domain", "d.com"), ("ip", "1.1.1.1")]
    with pytest.raises(ValueError):
        read_feed(spark, "nobody", "x")


def test_old_verdicts_do_not_count(spark):
    store = spark.createDataFrame(
        [("ip", "1.1.1.1", True, "t", 80.0, "s", "2024-01-30 00:00:00"), ("ip", "2.2.2.2", True, "t", 80.0, "s", "2024-01-01 00:00:00")],
        "type string, indicator string, is_malicious boolean, threat_type string, score double, source string, last_updated string",
    ).withColumn("last_updated", F.col("last_updated").cast("timestamp"))
    items = spark.createDataFrame([("1.1.1.1",), ("2.2.2.2",), ("bad",)], "indicator string")
    got = {r.indicator: (r.is_malicious, r.error) for r in intel.lookup(items, store, "ip", AS_OF).collect()}
    assert got == {"1.1.1.1": (True, None), "2.2.2.2": (False, None), "bad": (False, "Invalid IP format")}


def test_attack_catalog(spark, tmp_path):
    bundle = {
        "objects": [
            {"type": "attack-pattern", "name": "Brute Force", "description": "passwords", "external_references": [{"external_id": "T1110"}],
             "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": "credential-access"}, {"kill_chain_name": "x", "phase_name": "y"}]},
            {"type": "attack-pattern", "name": "No id", "external_references": [{"external_id": "CAPEC-1"}]},
            {"type": "x-mitre-tactic", "name": "Credential Access", "external_references": [{"external_id": "TA0006"}]},
        ]
    }
    (tmp_path / "b.json").write_text(json.dumps(bundle, indent=1))
    techniques, tactics = read_attack_catalog(spark, str(tmp_path / "b.json"))
    assert [(r.technique_id, r.tactics) for r in techniques.collect()] == [("T1110", ["credential-access"])]
    assert [r.tactic_id for r in tactics.collect()] == ["TA0006"]


def test_manifest(spark, tmp_path):
    import hashlib

    for name, text in (("a.rules", "one"), ("b.rules", "two")):
        (tmp_path / name).write_text(text)
    stored = spark.createDataFrame(evidence_manifest(spark, str(tmp_path)).collect())
    assert {r.name: r.sha256 for r in stored.collect()}["a.rules"] == hashlib.sha256(b"one").hexdigest()
    (tmp_path / "a.rules").write_text("changed")
    (tmp_path / "c.rules").write_text("new")
    (tmp_path / "b.rules").unlink()
    got = {r.name: r.status for r in verify_manifest(stored, evidence_manifest(spark, str(tmp_path))).collect()}
    assert got == {"a.rules": "changed", "b.rules": "missing", "c.rules": "new"}


@pytest.mark.parametrize("large", [0, 10, 10**9])
def test_manifest_reads_large_files_in_pieces(spark, tmp_path, monkeypatch, large):
    """Files above a limit give the checksums of whole files, whatever their names."""
    import gzip
    import hashlib

    monkeypatch.setattr("tracehold.sources.evidence.PIECE", 1 << 16)
    contents = {"a b%20c.log": b"x" * 11, "empty": b"", "sub/\u00e9#1.bin": bytes(range(256)) * 3000, "ten": b"0123456789", "packed.gz": gzip.compress(b"0123456789" * 9)}
    (tmp_path / "sub").mkdir()
    for name, body in contents.items():
        (tmp_path / name).write_bytes(body)
    (tmp_path / "sub" / str(tmp_path)[1:]).mkdir(parents=True)  # the folder's own path once more, inside it
    inner = f"sub{tmp_path}/in"
    contents[inner] = b"inside"
    (tmp_path / inner).write_bytes(b"inside")
    form = {0: "file://{}", 10: "{}/", 10**9: "file:{}"}[large]
    got = {r.name: (r["size"], r.sha256) for r in evidence_manifest(spark, form.format(tmp_path), large=large).collect()}
    assert got == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in contents.items()}


def test_manifest_of_a_file_beyond_one_value(spark, tmp_path):
    """A sparse file of more bytes than one value can hold."""
    import hashlib

    with open(tmp_path / "big", "wb") as file:
        file.seek((2 << 30) + 5)
        file.write(b"end")
    with open(tmp_path / "big", "rb") as file:
        want = hashlib.file_digest(file, "sha256").hexdigest()
    assert [tuple(r) for r in evidence_manifest(spark, str(tmp_path)).collect()] == [("big", (2 << 30) + 8, want)]


@pytest.mark.parametrize("rows,batch", [(700, 10_000), (6_000, 50)])
def test_forest_is_the_plain_forest_on_the_same_draws(spark, rows, batch):
    from tracehold.operators.forest import SAMPLE_ROWS, SEED, average_path, draws, grow_forest, tree_of
    from tracehold.session import stage

    rng = np.random.default_rng(2)
    # A third of the rows are equal; the third place holds codes.
    data = [(i, [1.0, 1.0, 1.0] if i % 3 == 0 else [float(rng.normal()), float(rng.normal()), float(rng.integers(0, 40))]) for i in range(rows)]
    table = stage(spark.createDataFrame(data, "id long, x array<double>").repartition(5, "id"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        forest = grow_forest(table, "x", ["a", "b", "c"], trees=12, coded=frozenset([2]))
        got = {r.id: r.s for r in table.select("id", forest.score(spark, F.col("x")).alias("s")).collect()}
        taken = draws(table, "x", 12).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == rows and taken["tree"].nunique() == 12
    trees = []
    for tree, part in taken.groupby("tree"):
        order = part.assign(p=part["at"].map(tuple)).sort_values(["draw", "p"]).head(SAMPLE_ROWS)
        assert len(order) == min(rows, SAMPLE_ROWS) == order["p"].nunique()
        trees.append(tree_of(int(tree), np.stack(order["x"]), SEED, frozenset([2])))
    # Trees draw rows of their own.
    firsts = [frozenset(part.sort_values("draw")["at"].map(tuple).head(50)) for _, part in taken.groupby("tree")]
    assert len(set(firsts)) == 12
    for i, x in data[:300]:
        path = 0.0
        for nodes in trees:
            at = 0
            while nodes[at][0] >= 0:
                feature, code, cut, child, _ = nodes[at]
                value = x[feature] if code < 0 else float(x[feature] == code)
                at = child + (value > cut)
            path += nodes[at][4]
        assert got[i] == pytest.approx(-(2 ** (-path / 12 / float(average_path(SAMPLE_ROWS)))))


def test_any_number_of_levels_and_classes(spark, tmp_path):
    """One level a row, hundreds of classes, a hot level, nulls and unknown levels."""
    rows = [(i, f"name{i:05d}", None if i % 9 == 0 else "hot" if i % 3 else f"rare{i % 7}", f"class{i % 300:04d}", float(i % 300)) for i in range(12_000)]
    df = spark.createDataFrame(rows, "id long, name string, kind string, label string, v double")
    features = fit_features(df, ["v"], ["name", "kind"])
    assert features.categorical == {"name": 12_000, "kind": 8}
    got = {r.id: r.x for r in features.coded(df, "x").select("id", "x").collect()}
    assert [got[i][1] for i in (0, 1, 11_999)] == [0, 1, 11_999] and [got[i][2] for i in (0, 1, 3)] == [0, 0, 4]
    vector = features.transform(df.where("id = 11999"), "f").first().f
    assert vector.size == 1 + 11_999 + 7 and [i for i in vector.indices if i] == [11_999]
    new = spark.createDataFrame([(1.0, "nobody", "rare6")], "v double, name string, kind string")
    assert features.coded(new, "x").first().x[1:] == [0.0, 7.0]
    assert features.names(spark, [0, 11_999, 12_006]) == {0: "v", 11_999: "name_name11999", 12_006: "kind_rare6"}
    model = models.train_anomaly_model(df, "id", ["v"], ["name", "kind"])
    models.save_model(spark, model, str(tmp_path), "names")
    again = models.load_model(spark, str(tmp_path), "names")
    models.save_model(spark, again, str(tmp_path), "names")
    a, b = (sorted((r.id, r.anomaly_score) for r in m.transform(df).select("id", "anomaly_score").collect()) for m in (model, again))
    assert [i for i, _ in a] == [i for i, _ in b] == list(range(12_000)) and [s for _, s in a] == pytest.approx([s for _, s in b])
    clf = models.train_classifier(df, "label", ["v"], ["name"], trees=2)
    # Fewer than two rows of 12,000 are below the share, so all names but the first share a column.
    assert clf.features.categorical == {"name": 2} and len(clf.config["classes"]) == 300
    scored = clf.transform(df.limit(50), columns=False).collect()
    assert {len(r.probabilities) for r in scored} == {300} and all(r.predicted_class.startswith("class") for r in scored)


def test_rare_levels_share_a_code(spark):
    df = spark.createDataFrame([("a",)] + [("b",)] * 50 + [("c",), ("d",), (None,)] + [("e",)] * 46, "k string")
    model = fit_features(df, categorical=["k"], level_share=0.02)
    got = {(r.k, r._code0) for r in model.with_codes(df).collect()}
    assert got == {("a", 0), ("b", 1), ("e", 2), ("c", 3), ("d", 3), (None, 0)} and model.categorical == {"k": 4}
    empty = fit_features(df.limit(0), ["k"], ["k"])
    assert empty.categorical == {"k": 0} and empty.coded(df, "x").count() == 100
