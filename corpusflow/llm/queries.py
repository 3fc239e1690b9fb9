"""The corpus operators on the shared tables, and the SQL that checks them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


@query("op10_exact_dedup", r"""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
           FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)""")
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import exact_dedup
    docs = table(spark, sf_dir, "documents")
    return exact_dedup.dedup(docs, exact_dedup.fresh_index(spark, docs.schema["doc_id"].dataType))


@query("op5_benchmark_decontamination", r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[i:i + least(10, len(w)) - 1] AS g
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT DISTINCT len(g) AS k FROM win),
p AS (SELECT r, k, w[i:i + k - 1] AS g, i FROM (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
m AS (SELECT r, i, k, item_id FROM p JOIN win USING (g)),
h AS (SELECT r, count(DISTINCT x) AS n FROM (SELECT r, unnest(range(i, i + k)) AS x FROM m) GROUP BY r),
it AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS l FROM m GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_hit, coalesce(len(l), 0) AS n_items,
       sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN it USING (r)""")
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.report(decontaminate.scan(docs, table(spark, sf_dir, "benchmark")).drop("text", "spans"))


@query("op9_bpe")
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op4_token_files")
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_files
    return token_files.read_digests(spark, token_files.write(table(spark, sf_dir, "documents")))


@query("op3_ngram_join", r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT r, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS s
      FROM (SELECT r, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * k >= 90 * (nx.n + ny.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
c AS (SELECT r, r AS t FROM d UNION SELECT c.r, e.y FROM c JOIN e ON e.x = c.t)
SELECT a.doc_id, coalesce(n.n, 0) AS n_shingles, min(b.doc_id) AS component_id
FROM c JOIN d a ON a.r = c.r JOIN d b ON b.r = c.t LEFT JOIN n ON n.r = c.r GROUP BY c.r, a.doc_id, n.n""")
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_join
    return ngram_join.join(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_licences")
def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licences
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.scan(docs).drop("text", "matches")


def url_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of pages whose document is labelled; a URL's last number is the id of the document it shows."""
    shown = F.regexp_extract("url", r"/(\d{1,18})(?:[/.?#]|$)", 1)
    pages = table(spark, sf_dir, "pages").select("url", F.when(shown != "", shown.cast("long")).alias("doc_id"))
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return pages.join(labels, "doc_id").select("url", "bad")


@query("op1_url_filter")
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_filter
    return url_filter.judge(table(spark, sf_dir, "pages"), url_labels(spark, sf_dir))


@query("op7_warc", r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f""")
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc
    return warc.read(warc.write(table(spark, sf_dir, "pages"))).drop("url")


@query("op8_html_text")
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_text
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


@query("op13_hard_negatives", r"""
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS s
      FROM r a JOIN r b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.q) = len(b.q)),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS INTEGER) AS rank,
       n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 80 * p.s <= 100 * n.s AND 100 * n.s <= 100 * p.s
QUALIFY rank <= 5""")
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import hard_negatives
    return hard_negatives.mine(hard_negatives.relabelled(table(spark, sf_dir, "embeddings")))


def _repair_sql() -> str:
    """The cheapest edits by a recursion over each conversation's rows: s0 to s3 are the best (cost, audit, turns) so far in
    each state of the pattern, e2 and e3 the same after insertions."""
    def more(state: str, cost: str, letter: str, turn: str | None) -> str:
        turns = f"list_append({state}.t, {turn})" if turn else f"{state}.t"
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {turns}}} END"

    def least(*of: str) -> str:
        return f"list_min([{', '.join(of)}])"

    def read(state: str, role: str, initial: str) -> list[str]:
        kept = more(state, "late", "K", "role || ':' || text")
        changed = more(state, "3 + late", "R", f"'{role}:' || text")
        return [f"CASE WHEN fault < 1 OR fault = 3 THEN CASE WHEN left(role, 1) = '{initial}' THEN {kept} ELSE {changed} END END"]

    e2 = least("s2", *(more(s, "3", "I", "'user:'") for s in ("s0", "s1", "s3")))
    e3 = least("s3", more("e2", "3", "I", "'assistant:'"))
    drop = [more(s, "4", "D", None) for s in ("s0", "s1", "e2", "e3")]
    system = "CASE WHEN (fault < 1 OR fault = 3) AND left(role, 1) = 's' THEN " + more("s0", "late", "K", "role || ':' || text") + " END"
    kind = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR[])"
    return rf"""
WITH RECURSIVE bits AS (SELECT list(list_reduce([i, 0, 1, 2, 3, 4, 5, 6, 7], lambda t, j: xor(t >> 1, CASE WHEN t % 2 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS crc
              FROM (SELECT unnest(range(256)) AS i)),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))),
               lambda t, b: xor(t >> 8, crc[(xor(t, b) % 256) + 1])), 4294967295) % 20 AS k
      FROM conversations, bits),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
             CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM (SELECT *, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE k <> 0)),
r AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
                     WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
                     WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d)),
f AS (SELECT *, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS late, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM r),
g AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
             count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
             count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
st AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST({{'c': 0, 'a': '', 't': []}} AS {kind}) AS s0, CAST(NULL AS {kind}) AS s1, CAST(NULL AS {kind}) AS s2, CAST(NULL AS {kind}) AS s3 FROM g
  UNION ALL
  SELECT conv_id, i, {drop[0]}, {least(drop[1], system)}, {least(drop[2], *read("s0", "user", "u"), *read("s1", "user", "u"), *read("e3", "user", "u"))},
         {least(drop[3], *read("e2", "assistant", "a"))}
  FROM (SELECT *, {e3} AS e3 FROM (SELECT st.conv_id, f.i, s0, s1, s2, s3, role, text, fault, late, {e2} AS e2 FROM st JOIN f ON f.conv_id IS NOT DISTINCT FROM st.conv_id AND f.i = st.i + 1))),
o AS (SELECT conv_id, {least("s0", "e3")} AS o FROM (SELECT *, {e3} AS e3 FROM (SELECT st.*, {e2} AS e2 FROM st JOIN g ON g.conv_id IS NOT DISTINCT FROM st.conv_id AND g.n = st.i)))
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(o.c, 0) AS cost, coalesce(o.a, '') AS audit, sha256(coalesce(array_to_string(o.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM a.conv_id"""


@query("op12_conversation_repair", _repair_sql())
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import conversations
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))


@query("op11_suffix_array", r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT r, doc_id, i, hash(substring(h, 2 * i + 1, 100)) AS s FROM (SELECT r, doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100)),
m AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s),
c AS (SELECT r, i, CASE WHEN lag(i) OVER w IS NULL OR i > lag(i) OVER w + 50 THEN 1 ELSE 0 END AS new
      FROM g JOIN m USING (s) WHERE least < doc_id WINDOW w AS (PARTITION BY r ORDER BY i)),
p AS (SELECT r, min(i) AS a, max(i) + 50 AS b FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM c) GROUP BY r, k),
k AS (SELECT r, a, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS z FROM
      (SELECT r, a, b FROM p UNION ALL SELECT r, len(h) // 2, len(h) // 2 + 1 FROM d)),
t AS (SELECT k.r, string_agg(substring(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS rest FROM k JOIN d ON d.r = k.r GROUP BY k.r),
n AS (SELECT r, count(*) AS spans, sum(b - a) AS gone FROM p GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(rest, ''))) AS kept_sha256
FROM d LEFT JOIN t ON t.r = d.r LEFT JOIN n ON n.r = d.r""")
def op11_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring_dedup
    return substring_dedup.digests(table(spark, sf_dir, "documents"))
