"""Queries over dataset versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.canonical import canonical_json, redact_json, schema_errors
from ..operators import datasets as D
from ..registry import query
from ..sources import readers
from ..views import records_v1, records_v2, table, with_views

SEED = 20260730
IPAD = bytes(b ^ 0x36 for b in SEED.to_bytes(8, "big").ljust(64, b"\0")).hex()
OPAD = bytes(b ^ 0x5C for b in SEED.to_bytes(8, "big").ljust(64, b"\0")).hex()


SOURCE = '{"kind":"table","row":null,"source_hash":null,"uri":null}'


def _built(spark, sf_dir):
    """Records whose payload is the digest and the length of a text, so that SQL can write the same JSON."""
    rows = records_v1(spark, sf_dir)
    payload = F.to_json(F.struct(F.length("text").alias("chars"), F.sha2("text", 256).alias("digest")))
    meta = F.to_json(F.struct("lang", "source"))
    return D.build_records(rows, F.col("key"), payload, meta, F.array(F.concat(F.lit(" "), F.upper("lang"))), F.lit(SOURCE))


FRAME = "unhex(lpad(to_hex(octet_length(encode({0}))), 16, '0')) || encode({0})"
BUILT = f"""
b0 AS (SELECT key, '{{"chars":' || length(text) || ',"digest":"' || sha256(text) || '"}}' AS payload, '{{"lang":"' || lang || '","source":"' || source || '"}}' AS meta, '["' || lang || '"]' AS splits, '{SOURCE}' AS src, lang FROM v1),
b1 AS (SELECT *, sha256(payload) AS payload_hash FROM b0),
built AS (SELECT key, payload_hash, lang AS splits, sha256({" || ".join(FRAME.format(c) for c in ("key", "payload_hash", "meta", "splits", "src"))}) AS envelope_hash FROM b1)"""


@query(with_views("v1", """
SELECT key, sha256(text) AS text_hash, sha256(unhex(lpad(to_hex(octet_length(encode(key))), 16, '0')) || encode(key) || unhex(lpad(to_hex(64), 16, '0')) || encode(sha256(text))) AS frame_hash FROM v1"""))
def ds05_frame(spark, sf_dir):
    """Length-framed digest of key and content digest."""
    h = F.sha2("text", 256)
    return records_v1(spark, sf_dir).select("key", h.alias("text_hash"), F.sha2(hashing.frame(F.col("key"), h), 256).alias("frame_hash"))


@query(with_views("v1", f"WITH {BUILT} SELECT key, payload_hash, envelope_hash, splits FROM built"))
def ds06_build_record(spark, sf_dir):
    return _built(spark, sf_dir).select("key", "payload_hash", "envelope_hash", F.concat_ws(",", "splits").alias("splits"))


HEAD7 = FRAME.format("'dataset-c14n/1'") + "".join(f" || unhex('0000000000000020') || unhex(sha256('{x}'))" for x in ('{"type":"object"}', "{}"))


@query(with_views("v1", f"""WITH {BUILT} SELECT sha256(encode('llm-eval-dataset') || unhex('00') || {HEAD7} || unhex(string_agg('0000000000000020' || envelope_hash, '' ORDER BY key))) AS content_hash, count(*) AS n_records FROM built"""))
def ds07_version_hash(spark, sf_dir):
    return D.version_hash(_built(spark, sf_dir), '{"type":"object"}', "{}")


@query()
def ds07b_tree_hash(spark, sf_dir):
    return D.tree_hash(_built(spark, sf_dir))


DIFF = """
d AS (SELECT coalesce(v1.key, v2.key) AS key, CASE WHEN v1.key IS NULL THEN 'added' WHEN v2.key IS NULL THEN 'removed'
  WHEN v1.text IS NOT DISTINCT FROM v2.text AND v1.lang IS NOT DISTINCT FROM v2.lang AND v1.source IS NOT DISTINCT FROM v2.source THEN 'unchanged' ELSE 'modified' END AS kind,
  v1.text AS a, v2.text AS b FROM v1 FULL OUTER JOIN v2 ON v1.key = v2.key)"""


def _nested(rows, second: bool):
    """Records with nested payloads; in a second version members come and go at several depths."""
    k = F.substring("key", -1, 1)
    changed = lambda digit, a, b: F.when(k == digit, b).otherwise(a) if second else F.lit(a)
    tail = F.when(k == "2", F.lit('","new":[1]')).otherwise(F.concat(F.lit('","c~d":"'), "source", F.lit('"'))) if second else F.concat(F.lit('","c~d":"'), "source", F.lit('"'))
    text = F.concat(F.lit('{"input":{"chars":'), F.length("text").cast("string"), F.lit(',"digest":"'), F.sha2("text", 256), F.lit('"},"tags":{"a/b":"'), "lang", tail, F.lit("}}"))
    meta = F.concat(F.lit('{"deep":{"er":{"est":'), changed("3", "null", "0"), F.lit("}},"), F.lit('"list":'), changed("4", "[1,2]", "[1,3]"), F.lit("}"))
    splits = F.when(k == "5", F.array("lang", F.lit("x"))).otherwise(F.array("lang")) if second else F.array("lang")
    return rows.select("key", meta.alias("metadata"), text.alias("payload"), splits.alias("splits"), F.sha2(F.concat(meta, text, F.to_json(splits)), 256).alias("envelope_hash"))


def _nested_sql(name: str, view: str, second: bool) -> str:
    """The same records as one JSON value each."""
    changed = lambda digit, a, b: f"CASE WHEN right(key, 1) = '{digit}' THEN '{b}' ELSE '{a}' END" if second else f"'{a}'"
    tail = "'\",\"c~d\":\"' || source || '\"'"
    tail = f"CASE WHEN right(key, 1) = '2' THEN '\",\"new\":[1]' ELSE {tail} END" if second else tail
    return f"""{name} AS (SELECT key, ('{{"metadata":{{"deep":{{"er":{{"est":' || {changed("3", "null", "0")} || '}}}},"list":' || {changed("4", "[1,2]", "[1,3]")} || '}},"payload":{{"input":{{"chars":' || length(text)
 || ',"digest":"' || sha256(text) || '"}},"tags":{{"a/b":"' || lang || {tail} || '}}}},"splits":["' || lang || {changed("5", '"]', '","x"]')} || '}}')::JSON AS j FROM {view})"""


@query(with_views("v1 v2", f"""WITH RECURSIVE {_nested_sql("n1", "v1", False)}, {_nested_sql("n2", "v2", True)},
e AS (SELECT coalesce(n1.key, n2.key) AS key, n1.j AS b, n2.j AS a, CASE WHEN n1.key IS NULL THEN 'added' WHEN n2.key IS NULL THEN 'removed' WHEN n1.j::VARCHAR = n2.j::VARCHAR THEN 'unchanged' ELSE 'modified' END AS kind FROM n1 FULL OUTER JOIN n2 ON n1.key = n2.key),
w AS (SELECT key, '' AS p, b, a FROM e WHERE kind = 'modified'
 UNION ALL SELECT key, p || x, json_extract(b, x), json_extract(a, x) FROM (SELECT key, p, b, a, '/' || replace(replace(m, '~', '~0'), '/', '~1') AS x FROM
  (SELECT key, p, b, a, unnest(list_distinct(list_concat(json_keys(b), json_keys(a)))) AS m FROM w WHERE json_type(b) = 'OBJECT' AND json_type(a) = 'OBJECT')) WHERE json_extract(b, x)::VARCHAR IS DISTINCT FROM json_extract(a, x)::VARCHAR),
c AS (SELECT key, string_agg(p || '=' || coalesce(b::VARCHAR, '-') || '>' || coalesce(a::VARCHAR, '-'), ';' ORDER BY p) AS changes FROM w WHERE NOT coalesce(json_type(b) = 'OBJECT' AND json_type(a) = 'OBJECT', false) GROUP BY key)
SELECT e.key, kind, coalesce(changes, '') AS changes FROM e LEFT JOIN c ON e.key = c.key"""))
def ds08_diff_versions(spark, sf_dir):
    """All changes of all records, members of nested objects by their pointers."""
    d = D.diff_records(_nested(records_v1(spark, sf_dir), False), _nested(records_v2(spark, sf_dir), True))
    line = lambda c: F.concat(c["pointer"], F.lit("="), F.coalesce(c["before"], F.lit("-")), F.lit(">"), F.coalesce(c["after"], F.lit("-")))
    return d.select("key", "kind", F.array_join(F.array_sort(F.transform("changes", line)), ";").alias("changes"))


@query(with_views("v1 v2", f"""WITH {DIFF}
SELECT kind, coalesce(n, 0)::BIGINT AS n FROM (VALUES ('added'), ('removed'), ('modified'), ('unchanged')) k(kind) LEFT JOIN (SELECT kind, count(*) AS n FROM d GROUP BY kind) USING (kind)"""))
def ds08b_diff_counts(spark, sf_dir):
    return D.diff_counts(D.diff_versions(records_v1(spark, sf_dir), records_v2(spark, sf_dir), ["text", "lang", "source"]))


HMAC_SQL = f"sha256(unhex('{OPAD}') || unhex(sha256(unhex('{IPAD}') || encode(key))))"


@query(with_views("v1", f"SELECT key, {HMAC_SQL} AS score FROM v1"))
def ds09_sample_score(spark, sf_dir):
    return records_v1(spark, sf_dir).select("key", hashing.hmac_sha256(SEED, F.col("key")).alias("score"))


@query(with_views("v1", f"SELECT key, {HMAC_SQL} AS score FROM v1 ORDER BY score, key LIMIT 100"))
def ds10_deterministic_sample(spark, sf_dir):
    return D.deterministic_sample(records_v1(spark, sf_dir).select("key"), 100, SEED)


@query(with_views("v1", f"""WITH c AS (SELECT lang AS label, count(*) AS n, sum(count(*)) OVER () AS total FROM v1 GROUP BY lang),
s AS (SELECT label, (n * 100) // total AS base, (n * 100) % total AS rest FROM c),
q AS (SELECT label, base + (row_number() OVER (ORDER BY rest DESC, label) <= 100 - sum(base) OVER ())::INT AS quota FROM s),
k AS (SELECT label, quota, sha256(unhex('{SEED.to_bytes(8, "big").hex()}') || encode(label)) AS h FROM q),
p AS (SELECT key, label, quota, lpad(to_hex(xor(('0x' || substr(h, 1, 16))::UBIGINT, 3906369333256140342::UBIGINT)), 16, '0') || repeat('36', 56) AS ipad,
  lpad(to_hex(xor(('0x' || substr(h, 1, 16))::UBIGINT, 6655295901103053916::UBIGINT)), 16, '0') || repeat('5C', 56) AS opad FROM v1 JOIN k ON v1.lang = k.label),
r AS (SELECT key, label, quota, row_number() OVER (PARTITION BY label ORDER BY sha256(unhex(opad) || unhex(sha256(unhex(ipad) || encode(key)))), key) AS rank FROM p)
SELECT key, label FROM r WHERE rank <= quota"""))
def ds11_stratified_sample(spark, sf_dir):
    return D.stratified_sample(records_v1(spark, sf_dir).select("key", "lang"), 100, SEED, "lang").select("key", "label")


@query("SELECT event_id, '{\"k\":\"[REDACTED]\"}' AS redacted FROM events")
def ds12_redact_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", redact_json(["/k"])(F.col("props")).alias("redacted"))


@query("SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS canonical, sha256('{\"k\":' || json_extract_string(props, '$.k') || '}') AS content_hash FROM events")
def ds03_canonical_json(spark, sf_dir):
    c = table(spark, sf_dir, "events").select("event_id", canonical_json(F.col("props")).alias("canonical"))
    return c.select("event_id", "canonical", F.sha2("canonical", 256).alias("content_hash"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad((microsecond(ts) % 1000000)::VARCHAR, 6, '0'), '0') END || 'Z' AS utc FROM events")
def ds02_normalize_timestamp(spark, sf_dir):
    from ..functions.canonical import normalized_timestamp

    return table(spark, sf_dir, "events").select("event_id", normalized_timestamp(F.concat(F.col("ts").cast("string"), F.lit("+00:00"))).alias("utc"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}_]+') AS t FROM documents)
SELECT doc_id, len(list_distinct([array_to_string(t[i:i+4], ' ') FOR i IN range(1, greatest(len(t) - 4, 0) + 1)]))::BIGINT AS n_grams FROM w""")
def ds13_ngrams(spark, sf_dir):
    from ..functions.text import text_ngrams

    return table(spark, sf_dir, "documents").select("doc_id", F.size(text_ngrams(F.col("text"))).cast("long").alias("n_grams"))


@query("""WITH w AS (SELECT doc_id::VARCHAR AS key, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}_]+') AS t FROM documents),
l AS (SELECT key, list_distinct([array_to_string(t[i:i+4], ' ') FOR i IN range(1, greatest(len(t) - 4, 0) + 1)]) AS g FROM w),
v AS (SELECT 'b' || item_id AS key, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}_]+') AS t FROM benchmark),
r AS (SELECT key, list_distinct([array_to_string(t[i:i+4], ' ') FOR i IN range(1, greatest(len(t) - 4, 0) + 1)]) AS g FROM v),
le AS (SELECT key, len(g) AS n, unnest(g) AS x FROM l), re AS (SELECT key, len(g) AS n, unnest(g) AS x FROM r),
p AS (SELECT le.key AS left_key, re.key AS right_key, count(*) AS c, max(le.n) AS nl, max(re.n) AS nr FROM le JOIN re USING (x) GROUP BY ALL)
SELECT left_key, right_key, round(c / (nl + nr - c), 9) AS similarity FROM p WHERE c / (nl + nr - c) >= 0.05
UNION ALL SELECT l.key, r.key, 1.0 FROM l, r WHERE len(l.g) = 0 AND len(r.g) = 0""")
def ds15_contamination_matches(spark, sf_dir):
    left = records_v1(spark, sf_dir).select("key", "text")
    right = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("key"), "text")
    return D.contamination_matches(left, right, threshold=0.05).select("left_key", "right_key", F.round("similarity", 9).alias("similarity"))


@query("""WITH w AS (SELECT doc_id::VARCHAR AS key, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}_]+') AS t FROM documents),
l AS (SELECT min(key) AS key, count(*) AS rows, g FROM (SELECT key, list_sort(list_distinct([array_to_string(t[i:i+4], ' ') FOR i IN range(1, greatest(len(t) - 4, 0) + 1)])) AS g FROM w) GROUP BY g),
v AS (SELECT (item_id + 1000000)::VARCHAR AS key, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}_]+') AS t FROM benchmark UNION ALL SELECT key, t FROM w WHERE key::BIGINT % 7 = 0),
r AS (SELECT min(key) AS key, count(*) AS rows, g FROM (SELECT key, list_sort(list_distinct([array_to_string(t[i:i+4], ' ') FOR i IN range(1, greatest(len(t) - 4, 0) + 1)])) AS g FROM v) GROUP BY g),
le AS (SELECT key, rows, len(g) AS n, unnest(g) AS x FROM l), re AS (SELECT key, rows, len(g) AS n, unnest(g) AS x FROM r),
p AS (SELECT le.key AS a, re.key AS b, any_value(le.rows) AS ar, any_value(re.rows) AS br, count(*) AS c, max(le.n) AS nl, max(re.n) AS nr FROM le JOIN re USING (x) GROUP BY ALL),
m AS (SELECT a, b, ar, br, c / (nl + nr - c) AS s FROM p WHERE c / (nl + nr - c) >= 0.8 UNION ALL SELECT l.key, r.key, l.rows, r.rows, 1.0 FROM l, r WHERE len(l.g) = 0 AND len(r.g) = 0)
SELECT a AS left_key, b AS right_key, round(s, 9) AS similarity, ar AS left_rows, br AS right_rows, ar * br AS links, row_number() OVER (ORDER BY s DESC, a, b) AS position FROM m""")
def ds15b_contamination_classes(spark, sf_dir):
    """Texts against the benchmark and every seventh text, alike to 0.8: linked classes, in order."""
    left = records_v1(spark, sf_dir).select("key", "text")
    items = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1_000_000).cast("string").alias("key"), "text")
    pairs, _, _ = D.contamination_classes(left, items.unionByName(left.where("cast(key as bigint) % 7 = 0")))
    made = pairs.select(F.col("left_first").alias("left_key"), F.col("right_first").alias("right_key"), "similarity", "left_rows", "right_rows", "links")
    return D.ordered_matches(made).withColumn("similarity", F.round("similarity", 9))


def _signed(spark, sf_dir):
    """Exact signatures (128 permutations, BLAKE2b) of all records and the benchmark's items."""
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("key"), "text")
    return D.minhash_signatures(records_v1(spark, sf_dir).select("key", "text").unionByName(items), n=5, permutations=128, seed=7)


@query()
def ds17_lsh_buckets(spark, sf_dir):
    """Membership of the LSH buckets (16 bands of 8) of all records and the benchmark's items."""
    from ..streaming.progress import shared_folder

    folder = shared_folder(spark)  # the signatures are read twice
    _signed(spark, sf_dir).write.mode("overwrite").parquet(folder)
    return D.lsh_buckets(D.lsh_bands(spark.read.parquet(folder)))


@query()
def ds16_minhash_signature(spark, sf_dir):
    """The exact keyed signature (BLAKE2b), as Arrow batches."""
    return _signed(spark, sf_dir)


@query(with_views("v1", """WITH p AS (SELECT text, count(*) AS c FROM v1 GROUP BY text), k AS (SELECT key, count(*) AS c FROM v1 GROUP BY key)
SELECT (SELECT sum(c) FROM k)::BIGINT AS n_records, (SELECT sum(c - 1) FROM k)::BIGINT AS duplicate_key_count, (SELECT sum(c - 1) FROM p)::BIGINT AS duplicate_payload_count,
 (SELECT count(DISTINCT lang) FROM v1) AS n_splits"""))
def ds18_publish_summary(spark, sf_dir):
    return D.publish_summary(_built(spark, sf_dir).withColumn("split", F.get("splits", F.lit(0))), "split")


@query(with_views("v1", "SELECT lang AS split, count(*) AS n FROM v1 GROUP BY lang"))
def agg19_split_counts(spark, sf_dir):
    return records_v1(spark, sf_dir).withColumn("splits", F.array("lang")).select(F.explode("splits").alias("split")).groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT coalesce(max(l_linenumber), 0) + 1 AS next_version, l_orderkey AS dataset FROM lineitem GROUP BY l_orderkey")
def ds19_next_version_number(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("dataset")).agg((F.coalesce(F.max("l_linenumber"), F.lit(0)) + 1).alias("next_version"))


SCHEMA = '{"type":"object","required":["k"],"additionalProperties":false,"properties":{"k":{"type":"integer","minimum":0,"maximum":7}}}'


@query("SELECT event_id, '/k' AS pointer, 'maximum' AS rule FROM events WHERE json_extract_string(props, '$.k')::BIGINT > 7")
def ds20_schema_errors(spark, sf_dir):
    """All schema errors of all payloads."""
    e = table(spark, sf_dir, "events").select("event_id", F.explode(schema_errors(SCHEMA)(F.col("props"))).alias("e"))
    return e.select("event_id", F.col("e.pointer").alias("pointer"), F.col("e.rule").alias("rule"))


@query("SELECT event_id AS row, event_id::VARCHAR AS key, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS payload FROM events")
def src05_normalize_envelope(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select(F.col("event_id").alias("row"), F.concat(F.lit('{"id": "'), F.col("event_id").cast("string"), F.lit('", "k": '), F.get_json_object("props", "$.k"), F.lit("}")).alias("line"))
    return readers.normalize_envelope(lines).select("row", "key", "payload")


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 101")
def src10_keyset_page(spark, sf_dir):
    """A page of 100 rows after a key, and one more that tells whether another follows."""
    return readers.keyset_page(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), "event_id", 500, 100)


@query("""SELECT item_id, 'fake:' || trim(text, ' ') AS response, greatest(1, octet_length(encode(text)) // 4)::BIGINT AS input_tokens,
 greatest(1, octet_length(encode('fake:' || trim(text, ' '))) // 4)::BIGINT AS output_tokens,
 'fake-' || substr(sha256('fake' || chr(31) || text || chr(31) || '7'), 1, 24) AS request_id FROM benchmark""")
def src13_fake_generate(spark, sf_dir):
    return readers.fake_generate(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("prompt")), "fake", 7, separator="\x1f").drop("prompt")


@query("""WITH d AS (SELECT item_id, i, 2 * (('0x' || substr(sha256(i || chr(31) || text), 1, 16))::UBIGINT::DOUBLE / 18446744073709551615.0) - 1 AS x FROM benchmark, range(8) r(i)),
n AS (SELECT item_id, sqrt(sum(x * x)) AS norm FROM d GROUP BY item_id)
SELECT item_id, i::INT AS dim, round(x / norm, 9) AS value FROM d JOIN n USING (item_id)""")
def src14_fake_embed(spark, sf_dir):
    v = readers.fake_embed(table(spark, sf_dir, "benchmark").select("item_id", "text"), 8, separator="\x1f")
    return v.select("item_id", F.posexplode("vector").alias("dim", "value")).withColumn("value", F.round("value", 9))


@query("SELECT p_partkey, CASE WHEN regexp_matches(x, '^[=+\\-@\\t\\r]') THEN '''' || x ELSE x END AS cell FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '=' WHEN 1 THEN '-' WHEN 2 THEN '@' ELSE '' END || p_name AS x FROM part)")
def snk02_safe_cells(spark, sf_dir):
    from ..sources.sinks import safe_cell

    k = F.col("p_partkey") % 4
    x = F.concat(F.when(k == 0, "=").when(k == 1, "-").when(k == 2, "@").otherwise(""), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", safe_cell(x).alias("cell"))


@query("SELECT p_partkey::VARCHAR AS key, p_name, p_size FROM part")
def snk06_publish_and_read(spark, sf_dir):
    """A version is published as a whole, and read by its manifest."""
    from ..sources.sinks import publish_version
    from ..streaming.progress import shared_folder

    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), "p_name", "p_size")
    return publish_version(rows, shared_folder(spark), "1", "h").drop("content_hash")


@query("SELECT p_partkey::VARCHAR AS key, p_name AS name, p_brand AS brand FROM part")
def src01_jsonl_round_trip(spark, sf_dir):
    """Rows written as JSON lines and imported again as envelopes."""
    from ..streaming.progress import shared_folder

    folder = shared_folder(spark)
    table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand")).write.json(folder)
    e = readers.normalize_envelope(readers.read_records(spark, folder, "jsonl"))
    return e.select("key", F.get_json_object("payload", "$.name").alias("name"), F.get_json_object("payload", "$.brand").alias("brand"))


@query("SELECT p_partkey::VARCHAR AS key, p_name AS name, p_size::VARCHAR AS size FROM part")
def src02_csv_import(spark, sf_dir):
    """Rows written as CSV come back as strings."""
    from ..streaming.progress import shared_folder

    folder = shared_folder(spark)
    table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size")).write.option("header", True).csv(folder)
    e = readers.normalize_envelope(readers.read_records(spark, folder, "csv"))
    return e.select("key", F.get_json_object("payload", "$.name").alias("name"), F.get_json_object("payload", "$.size").alias("size"))


@query("SELECT n_nationkey::VARCHAR AS key, n_name AS name FROM nation")
def src03_parquet_import(spark, sf_dir):
    rows = readers.read_records(spark, f"{sf_dir}/nation.parquet", "parquet")
    e = readers.normalize_envelope(rows)
    return e.select(F.get_json_object("payload", "$.n_nationkey").alias("key"), F.get_json_object("payload", "$.n_name").alias("name"))


@query("SELECT item_id::VARCHAR AS id, 'c' || (item_id % 3) AS category, text AS prompt, 2::BIGINT AS n_answers FROM benchmark")
def src08_benchmark_cases(spark, sf_dir):
    """Cases with accepted answers, trimmed, with unique ids."""
    b = table(spark, sf_dir, "benchmark")
    cases = b.select(F.concat(F.lit(" "), F.col("item_id").cast("string")).alias("id"), F.concat(F.lit("c"), (F.col("item_id") % 3).cast("string")).alias("category"), F.col("text").alias("prompt"), F.array(F.lit(" a "), F.lit("b")).alias("accepted_answers"))
    return readers.benchmark_cases(cases).select("id", "category", "prompt", F.size("accepted_answers").cast("long").alias("n_answers"))


@query("SELECT 'docs/' || doc_id AS key, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS size, length(text)::BIGINT AS n_chars FROM documents")
def src11_object_round_trip(spark, sf_dir):
    """Every text put into the store and read again, its digest verified."""
    from ..sources.store import get_objects, put_objects
    from ..streaming.progress import shared_folder

    root = shared_folder(spark)
    d = table(spark, sf_dir, "documents")
    put_objects(d.select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("key"), F.col("text").alias("body"), F.sha2("text", 256).alias("expected_sha256")), root)
    return get_objects(spark, root).select("key", "sha256", "size", F.length(F.col("body").cast("string")).cast("long").alias("n_chars"))


@query(with_views("v1", f"""WITH b0 AS (SELECT key, '{{"chars":' || length(text) || ',"digest":"' || sha256(text) || '"}}' AS payload, '{{"lang":"' || lang || '","source":"' || source || '"}}' AS meta, '["' || lang || '"]' AS splits, '{SOURCE}' AS src FROM v1),
b1 AS (SELECT *, sha256(payload) AS ph FROM b0), b2 AS (SELECT *, sha256({" || ".join(FRAME.format(c) for c in ("key", "ph", "meta", "splits", "src"))}) AS eh FROM b1),
v AS (SELECT sha256(encode('llm-eval-dataset') || unhex('00') || {HEAD7} || unhex(string_agg('0000000000000020' || eh, '' ORDER BY key))) AS content_hash FROM b2)
SELECT row_number() OVER (ORDER BY key) AS position, '"sha256:' || content_hash || '"' AS etag,
 sha256('{{"envelope_hash":"' || eh || '","key":"' || key || '","metadata":' || meta || ',"payload":' || payload || ',"payload_hash":"' || ph || '","splits":' || splits || '}}') AS line_hash FROM b2, v"""))
def snk05_export_version(spark, sf_dir):
    """The canonical lines of a version in key order, read back from its objects, with the version's ETag."""
    from ..sources.store import export_version, read_export
    from ..streaming.progress import shared_folder

    built, root = _built(spark, sf_dir), shared_folder(spark)
    content_hash = D.version_hash(built, '{"type":"object"}', "{}").first()["content_hash"]
    manifest = export_version(built, content_hash, root, "v1", part_rows=300)
    lines = D.positions(read_export(spark, root, "v1"), ["position", "line_number"], "place")
    etag = manifest.select("position", "etag")
    return lines.join(F.broadcast(etag), "position").select(F.col("place").alias("position"), "etag", F.sha2("line", 256).alias("line_hash"))
