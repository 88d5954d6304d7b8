"""Named queries of the operators, one per number, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracehold.session import staging_path, tune

QUERIES = {}
ORACLES = {}


#: Whole texts make long rows, so fewer of them go to a Python worker at once.
BATCH_ROWS = "2000"


def prepared(spark: SparkSession) -> SparkSession:
    tune(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def query(function, sql: str | None = None):
    QUERIES[function.__name__] = lambda spark, folder: function(prepared(spark), folder)
    if sql:
        ORACLES[function.__name__] = sql
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Lowering A-Z only, and the word patterns of the contracts.
LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


#: The rules of the contract, as host/path and verdict.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op5_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    from tracehold.llm.url_rules import judge_urls

    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return judge_urls(table(spark, folder, "pages"), table(spark, folder, "labels"), URL_RULES, bad)


query(op5_url_rules)


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from tracehold.llm.substrings import remove_repeats

    return remove_repeats(table(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


query(
    op6_substring_dedup,
    r"""
    with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) w from documents),
    s as (select doc_id, i, array_to_string(w[i:i + 49], ' ') g from (select *, unnest(range(1, len(w) - 48)) i from d where len(w) >= 50)),
    m as (select g, min(doc_id) low from s group by 1),
    gone as (select distinct doc_id, unnest(range(i, i + 50)) p from s join m using (g) where low < doc_id),
    p as (select doc_id, w, unnest(range(1, len(w) + 1)) p from d),
    k as (select doc_id, string_agg(w[p], ' ' order by p) kept, count(*) n from p anti join gone using (doc_id, p) group by 1)
    select doc_id, len(w) n_words, len(w) - coalesce(n, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256
    from d left join k using (doc_id)""",
)


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    from tracehold.llm.quality import score_quality

    return score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


query(op7_quality)


def op8_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    from tracehold.llm.personal_data import find_personal_data

    found = find_personal_data(table(spark, folder, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


query(op8_personal_data)


def op9_metric_join(spark: SparkSession, folder: str) -> DataFrame:
    from tracehold.llm.metric_join import similar_vectors

    return similar_vectors(table(spark, folder, "embeddings"))


query(
    op9_metric_join,
    """
    with recursive v as (
        select vec_id, label, cast(embedding as double[]) e from embeddings
        where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
          and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    p as (select a.vec_id x, b.vec_id y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
          where list_cosine_similarity(a.e, b.e) >= 0.93),
    r as (select vec_id a, vec_id b from embeddings union select a, y from r join p on r.b = p.x)
    select vec_id, coalesce(n, 0) n_links, component_id, vec_id = component_id kept
    from embeddings left join (select x vec_id, count(*) n from p group by 1) using (vec_id)
    join (select a vec_id, min(b) component_id from r group by 1) using (vec_id)""",
)


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    from tracehold.llm.decontaminate import decontaminate

    found = decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", "contaminated")


query(
    op10_decontaminate,
    f"""
    with d as (select doc_id, regexp_extract_all({LOWERED}, {ALNUM}) w from documents),
    b as (select item_id, regexp_extract_all({LOWERED}, {ALNUM}) w from benchmark),
    bw as (select distinct item_id, least(10, len(w)) n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') s
           from (select *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from b where len(w) > 0)),
    dw as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') s
           from (select d.*, n, unnest(range(1, len(w) - n + 2)) i from d, (select distinct n from bw) where len(w) >= n)),
    hit as (select doc_id, i, n, item_id from dw join bw using (n, s)),
    covered as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hit) group by 1),
    named as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) ids
              from (select distinct doc_id, cast(item_id as varchar) item_id from hit) group by 1)
    select doc_id, coalesce(len(w), 0) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
           sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
    from d left join covered using (doc_id) left join named using (doc_id)""",
)


def op1_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    from tracehold.llm.revisits import captures_of, resolve_revisits

    found = resolve_revisits(captures_of(table(spark, folder, "pages")))
    merged = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return found.select("record_id", "canonical_url", "response_id", "outcome", merged.alias("headers"))


query(
    op1_warc_revisits,
    r"""
    with p as (select page_id, url, html, cast('0x' || substr(md5(coalesce(url, '')), 1, 4) as int) n from pages),
    a as (select page_id, url, n, md5(coalesce(html, '')) digest, length(coalesce(html, '')) size, 'day ' || (page_id % 365) changed from p),
    r as (select 2 * page_id id, url, page_id * 60 t, 0 later, digest, size, changed, '"' || digest || '"' tag, page_id from a),
    v as (select 2 * page_id + 1 id, case when n % 2 = 0 then url || '#again' else url end url,
                 page_id * 60 + case when n % 7 = 0 then -30 else 86400 end t,
                 case n % 5 when 0 then '"' || digest || '"' when 1 then '"' || digest || '"' when 2 then '"stale"' end tag,
                 case n % 5 when 1 then 'W/' else '' end weak, case when n % 5 = 3 then changed end changed, page_id from a),
    x as (select id, true resp, url from r union all select id, false, url from v),
    y as (select id, resp, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://', '') rest from x),
    z as (select id, resp, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), '^www[0-9]*\.', ''), ':(80|443)$', '')
                 || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') hp,
                 array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
                   lambda q: q <> '' and not regexp_matches(lower(q), '^(utm_[a-z]+|fbclid|gclid|sessionid|phpsessid)(=|$)'))), '&') q from y),
    u as (select id, hp || case when q = '' then '' else '?' || q end u from z),
    j as (select v.id, vu.u, v.tag, v.weak, v.changed, v.page_id, max_by(r.id, (r.t, r.id)) filter (where r.id is not null) rid
          from v join u vu on vu.id = v.id left join (r join u ru on ru.id = r.id) on ru.u = vu.u and vu.u <> '' and r.t <= v.t
          group by all),
    k as (select j.id, j.u, j.rid, j.tag, j.weak, j.page_id, r.tag rtag, r.size, r.changed rchanged,
                 case when rid is null then 'missing' when j.tag is not null then (case when j.tag = r.tag then 'resolved' else 'changed' end)
                      when j.changed is not null then (case when j.changed = r.changed then 'resolved' else 'changed' end) else 'unverified' end outcome
          from j left join r on r.id = j.rid)
    select id record_id, u canonical_url, case when outcome = 'resolved' then rid end response_id, outcome,
           case when outcome = 'resolved' then 'content-length=' || size || ';content-type=text/html;date=' || page_id || ';etag='
                || coalesce(weak || tag, rtag) || ';last-modified=' || rchanged || ';server=archive' end headers
    from k""",
)


def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    from tracehold.llm.near_duplicates import near_duplicates

    return near_duplicates(table(spark, folder, "documents"), words_per_shingle=2)


query(
    op2_near_duplicates,
    f"""
    with recursive d as (select doc_id, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') w from documents),
    s as (select distinct doc_id, unnest(case when len(w) >= 2 then [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]
                                              when len(w) = 1 then w else [] end) g from d),
    n as (select doc_id, count(*) n from s group by 1),
    p as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
    e as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 80 * (nx.n + ny.n - c)),
    r as (select doc_id a, doc_id b from d union select a, y from r join e on r.b = e.x)
    select d.doc_id, coalesce(n, 0) n_shingles, component_id, d.doc_id = component_id kept
    from d left join n using (doc_id) join (select a doc_id, min(b) component_id from r group by 1) using (doc_id)""",
)


def op3_token_file(spark: SparkSession, folder: str) -> DataFrame:
    from tracehold.llm.token_file import read_tokens, write_tokens

    path = staging_path(spark, "tokens")
    write_tokens(table(spark, folder, "documents"), path, "word_bpe_49k.json", end_id=1)
    return read_tokens(spark, path)


query(op3_token_file)


def op4_sum_of_squares_packing(spark: SparkSession, folder: str) -> DataFrame:
    from tracehold.llm.packing import pack_documents

    return pack_documents(table(spark, folder, "documents"), "byte_bpe_50k.json", end_id=2)


query(op4_sum_of_squares_packing)


def op11_bpe_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    from tracehold.llm.bpe import encode_texts

    both = encode_texts(table(spark, folder, "documents"), "byte_bpe_50k.json", decoded=True)
    listed = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), listed.alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


query(op11_bpe_prefixes)


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    from tracehold.llm.collocations import collocations

    return collocations(table(spark, folder, "documents"))


query(
    op12_collocations,
    rf"""
    with p as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array({LOWERED}, '[.,;:!?\x0A-\x0D]')) p from documents),
    w as (select lang, regexp_extract_all(p, '[^\x20\x09]+') w from p),
    g as (select lang, k, array_to_string(w[i:i + k - 1], ' ') phrase
          from (select lang, w, k, unnest(range(1, len(w) - k + 2)) i from w, (select unnest([1, 2, 3]) k) where len(w) >= k)),
    f as (select lang, k, phrase, count(*) n from g group by all),
    t as (select lang, sum(n) total from f where k = 1 group by 1),
    c as (select lang, k, phrase, n a, string_split(phrase, ' ') w from f where k >= 2 and n >= 10),
    u as (select *, array_to_string(w[1:j], ' ') x, array_to_string(w[j + 1:], ' ') y
          from (select *, unnest(range(1, k)) j from c)),
    s as (select u.lang, u.k, u.phrase, a, w, j, fx.n l, fy.n r,
                 cast(a as hugeint) * a * 1000000 // (cast(fx.n as hugeint) * fy.n) score
          from u join f fx on fx.lang = u.lang and fx.phrase = x join f fy on fy.lang = u.lang and fy.phrase = y),
    b as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1),
    i as (select lang, phrase, max(a) longer
          from (select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) phrase from c where k = 3) group by 1, 2),
    o as (select b.lang, b.phrase, a, l, r, score from b left join i using (lang, phrase) where longer is null or 100 * longer < 50 * a),
    e as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from o)
    select lang, rank, phrase, a, l, r, cast(total as bigint) n, cast(score as bigint) score from e join t using (lang) where rank <= 2000""",
)


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    from tracehold.llm.prefix_trie import prefix_trie

    return prefix_trie(table(spark, folder, "conversations"))


#: A table of checksums of single bytes, in SQL.
CRC_TABLE = "list_transform(range(256), lambda b: list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))"

query(
    op13_prefix_trie,
    f"""
    with recursive crc as (select {CRC_TABLE} t),
    o as (select conv_id c, row_number() over (partition by conv_id order by turn nulls first, digest) - 1 p, digest g, length(said) points
          from (select *, md5(length(r) || ':' || r || said) digest from (select *, coalesce(role, '') r, coalesce(text, '') said from conversations where conv_id is not null) q) q),
    h as (select c, c - c % 100 base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(c as varchar), ''), lambda s: cast(ascii(s) as bigint))),
              lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1])), 4294967295) % 6 h from (select distinct c from o) q, crc),
    r as (select h.c, o.p, 0 own, g, points from h join o on o.c = h.base and o.p < h.h
          union all select h.c, o.p, 1, g, points from h join o on o.c = h.c and o.p >= h.h),
    s as (select c, row_number() over w d, string_agg(g, '') over w path, points from r window w as (partition by c order by own, p)),
    m as (select c, d, path, points from s union all select c, 0, '', 0 from h),
    e as (select c, max(d) deep from m group by 1),
    n as (select d, path, min(c) c, count(*) n_convs, max(points) points from m group by 1, 2),
    z as (select m.d, path, string_agg(cast(m.c as varchar), ',' order by m.c) ids from m join e on e.c = m.c and e.deep = m.d group by 1, 2),
    k as (select d - 1 d, path[:-33] path, count(*) n_children from n where d > 0 group by 1, 2),
    t as (select n.*, coalesce(n_children, 0) n_children, coalesce(ids, '') ids from n left join k using (d, path) left join z using (d, path)),
    u as (select a.d, a.path, sum(cast(b.n_children = 0 as bigint)) n_leaves, sum((b.n_convs - 1) * b.points) saved
          from t a join t b on b.d >= a.d and substr(b.path, 1, 32 * a.d) = a.path group by 1, 2)
    select t.c conv_id, t.d depth, up.c parent_conv_id, t.n_convs, t.n_children, cast(n_leaves as bigint) n_leaves, cast(saved as bigint) saved_tokens, sha256(t.ids) ends_sha256
    from t join u using (d, path) left join n up on up.d = t.d - 1 and up.path = t.path[:-33] and t.d > 0""",
)


def llm_queries() -> dict:
    return dict(QUERIES)


def llm_oracles() -> dict[str, str]:
    return dict(ORACLES)
