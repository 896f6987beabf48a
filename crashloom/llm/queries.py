"""The registered queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontamination, gif_media, language_id, line_dedup, merkle, ngram_join, packing, personal_data, secret_scan, token_counts, toxicity, url_rules
from .common import ascii_lower, held_out, table

END_ID, SEQUENCE = 2, 1024


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: host, path, verdict
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 3, 1)
    found = language_id.predict(docs, language_id.learn(docs, ~out))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels, lambda k: ~held_out(k, 5, 0))
    return toxicity.score(docs, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secret_scan.rendered(F.col("base")), 256).alias("base_sha256"), secret_scan.rendered(F.col("spans")).alias("spans"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.report(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


def op7_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_media.digests(gif_media.store(table(spark, sf_dir, "documents")))


def op8_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), SEQUENCE, END_ID)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontamination.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), SEQUENCE)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = [F.translate("text", "\n", "") if f == "text" else F.col(f) for f in merkle.FIELDS]
    suspect = F.when(held_out(F.col("doc_id"), 2, 0), merkle.digest(*changed))
    found = merkle.prove(docs, suspect=suspect)
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    report, repaired = conversations.repair(conversations.damage(rows))
    done = report.join(conversations.digests(repaired).withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id")
    every = rows.select(F.col("conv_id").alias("_id")).distinct()
    found = every.join(done, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(F.col("_id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.scan(table(spark, sf_dir, "documents"))
    counts = [personal_data.count(F.col("base"), k).alias(f"n_{k}") for k in personal_data.KINDS]
    return found.select("doc_id", *counts, F.sha2(personal_data.rendered(F.col("base")), 256).alias("base_sha256"), personal_data.rendered(F.col("spans")).alias("spans"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_toxicity, op3_ngram_jaccard_join, op4_url_filter, op5_secret_scan, op6_line_dedup, op7_gif_media, op8_minimum_bin_slack, op9_decontamination, op10_token_counts, op11_merkle_manifest, op12_conversation_repair, op13_personal_data)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP3 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.a = d.doc_id
"""

_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
_OP4 = rf"""
WITH u AS (SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(h, p, v) AS (VALUES {_RULES_SQL}),
f AS (SELECT page_id, max((length(h) + length(p), length(h), h || p, v)) AS best
    FROM u JOIN r ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT u.page_id, host, path, best[3] AS rule, coalesce(best[4], 'allow') AS verdict FROM u LEFT JOIN f USING (page_id)
"""


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _found(name: str, pattern: str, keep: str, group: int = 0) -> str:
    """SQL for the spans of a pattern: gaps and matches alternate, so their running lengths are the positions."""
    p = _sql(pattern)
    return f"""{name}_m AS (SELECT doc_id, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {group}) AS v, list_transform(regexp_split_to_array(t, {p}), lambda x: length(x)) AS g FROM d WHERE regexp_matches(t, {p})),
{name}_s AS (SELECT doc_id, m[i] AS m, v[i] AS v, (coalesce(list_sum(g[1:i]), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS b FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {name}_m)),
{name} AS (SELECT doc_id, m, b, b + length(m) AS e FROM {name}_s WHERE {keep})"""


_KINDS = list(secret_scan.KINDS)
_CLASS = "[" + ", ".join(f"'{c}'" for c in secret_scan.KINDS.values()) + "]"
_NEEDS = " OR ".join(f"(w.c = '{c}' AND o.c = '{x}')" for c, n in secret_scan.NEEDS.items() for x in n)
_RENDER = "string_agg([" + ", ".join(f"'{k}'" for k in _KINDS) + "][o + 1] || ':' || b || ':' || e, ',' ORDER BY b, o, e)"
_OP5 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_found("fa", secret_scan.ASSIGN, f"length(v) >= {secret_scan.VALUE}", 2)},
{_found("fk", "AKIA[A-Z0-9]+", "length(m) >= 20")},
{_found("fh", "[0-9a-f]+", "length(m) >= 24")},
{_found("fw", secret_scan.ANY, "true")},
base AS (SELECT doc_id, b, e, 0 AS o FROM fa UNION ALL SELECT doc_id, b, e, 1 FROM fk UNION ALL SELECT doc_id, b, e, 2 FROM fh),
weak AS (SELECT doc_id, b, e, CASE WHEN regexp_full_match(m, {_sql(secret_scan.SHORT)}) THEN 4 WHEN regexp_full_match(m, {_sql(secret_scan.ENDPOINT)}) THEN 5
        WHEN regexp_full_match(m, {_sql(secret_scan.KEYED)}) THEN 6 WHEN regexp_full_match(m, {_sql(secret_scan.RUN)}) THEN CASE WHEN length(m) = {secret_scan.RUN_LENGTH} AND {" AND ".join(f"regexp_matches(m, '{p}')" for p in secret_scan.MIXED)} THEN 7 END ELSE 3 END AS o FROM fw
    WHERE NOT regexp_full_match(m, {_sql(secret_scan.ASSIGN)}) AND NOT regexp_full_match(m, {_sql(secret_scan.ACCESS)}) AND NOT regexp_full_match(m, {_sql(secret_scan.HEX)})),
part AS (SELECT *, {_CLASS}[o + 1] AS c FROM (SELECT * FROM base UNION ALL SELECT * FROM weak WHERE o IS NOT NULL)),
linked AS (SELECT DISTINCT w.doc_id, w.b, w.e, w.o FROM part w JOIN part o ON w.doc_id = o.doc_id AND abs(w.b - o.b) <= {secret_scan.SCOPE} AND ({_NEEDS}) WHERE w.o >= 3),
every AS (SELECT * FROM base UNION ALL SELECT * FROM linked),
bs AS (SELECT doc_id, {_RENDER} AS r, count(*) FILTER (o = 0) AS a, count(*) FILTER (o = 1) AS k, count(*) FILTER (o = 2) AS h FROM base GROUP BY doc_id),
es AS (SELECT doc_id, {_RENDER} AS r FROM every GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(bs.r, '')) AS base_sha256, coalesce(es.r, '') AS spans
FROM d LEFT JOIN bs USING (doc_id) LEFT JOIN es USING (doc_id)
"""

_OP6 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, no, ls[no + 1] AS line FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS no FROM d)),
e AS (SELECT * FROM l WHERE length(line) >= {line_dedup.EXACT}),
u AS (SELECT DISTINCT line, length(line) AS n FROM e),
f AS (SELECT a.line AS a, b.line AS b FROM u a JOIN u b ON b.n BETWEEN a.n - {line_dedup.EDITS} AND a.n + {line_dedup.EDITS} AND a.line <> b.line
    WHERE a.n >= {line_dedup.FUZZY} AND b.n >= {line_dedup.FUZZY} AND levenshtein(a.line, b.line) <= {line_dedup.EDITS}),
r(a, b) AS (SELECT line, line FROM u UNION SELECT r.a, f.b FROM r JOIN f ON r.b = f.a),
c AS (SELECT a AS line, min(b) AS c FROM r GROUP BY a),
k AS (SELECT doc_id, no, row_number() OVER (PARTITION BY c ORDER BY doc_id, no) > 1 AS gone FROM e JOIN c USING (line)),
t AS (SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (coalesce(gone, false)) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY l.no) FILTER (NOT coalesce(gone, false)), '') AS kept
    FROM l LEFT JOIN k ON l.doc_id = k.doc_id AND l.no = k.no GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, length(kept) AS n_chars_left, sha256(kept) AS text_sha256 FROM d LEFT JOIN t USING (doc_id)
"""

_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP9 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w, least(len({_WORDS}), 13) AS k FROM benchmark),
v AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM i WHERE k > 0)),
p AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d CROSS JOIN (SELECT DISTINCT k FROM v) WHERE len(w) >= k),
h AS (SELECT p.doc_id, v.item_id, p.s, v.k FROM p JOIN v ON p.k = v.k AND array_to_string(p.w[p.s:p.s + p.k - 1], ' ') = v.g),
n AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS x FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS t FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""



def _crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of an ASCII text: for each byte, eight steps of a bit."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295::BIGINT)"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({x}::VARCHAR) || ':' || {x}, '-')" for x in (text if f == "text" else f for f in merkle.FIELDS)) + ")"


_OP11 = rf"""
WITH RECURSIVE d AS (SELECT *, {_leaf("text")} AS leaf, CASE WHEN {_crc32("coalesce(doc_id::VARCHAR, '')")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS seen FROM documents),
l AS (SELECT doc_id, source, leaf, coalesce(seen, leaf) AS seen, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, seen NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
t(source, lvl, i, n, h) AS (SELECT source, 0, i, n, leaf FROM l
    UNION ALL SELECT source, max(lvl) + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY source, i // 3, (n + 2) // 3),
r AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u(lvl, i, n, h) AS (SELECT 0, i, n, h FROM r UNION ALL SELECT max(lvl) + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY i // 3, (n + 2) // 3),
every AS (SELECT source, true AS low, lvl, i, h, n FROM t UNION ALL SELECT NULL::VARCHAR, false, lvl, i, h, n FROM u),
run AS (SELECT source, low, lvl, i // 3 AS j, list(h ORDER BY i) AS hs, max(n) AS n FROM every GROUP BY source, low, lvl, i // 3),
f(doc_id, leaf, source, low, lvl, i, h, proof, top) AS (
    SELECT doc_id, leaf, source, true, 0, i, seen, '', NULL::VARCHAR FROM l
    UNION ALL SELECT f.doc_id, f.leaf, f.source, f.low AND run.n > 1, CASE WHEN f.low AND run.n = 1 THEN 0 ELSE f.lvl + 1 END, CASE WHEN run.n > 1 THEN f.i // 3 ELSE r.i END,
        CASE WHEN run.n > 1 THEN sha256(array_to_string(list_concat(list_concat(run.hs[1:f.i % 3], [f.h]), run.hs[f.i % 3 + 2:]), '')) ELSE f.h END,
        CASE WHEN run.n > 1 THEN f.proof || array_to_string(list_concat(run.hs[1:f.i % 3], run.hs[f.i % 3 + 2:]), '') ELSE f.proof END, CASE WHEN NOT f.low AND run.n = 1 THEN run.hs[1] END
    FROM f JOIN run ON f.low = run.low AND (NOT f.low OR f.source IS NOT DISTINCT FROM run.source) AND f.lvl = run.lvl AND f.i // 3 = run.j LEFT JOIN r ON f.source IS NOT DISTINCT FROM r.source WHERE f.top IS NULL)
SELECT doc_id, leaf, r.h AS subroot, top AS root, sha256(proof) AS proof_sha256, f.h AS folded_root, f.h = top AS verified
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source WHERE top IS NOT NULL
"""

_WHITE = "[\\x20\\x09-\\x0D]"


def _repair_step(q: int) -> str:
    """SQL for the best (cost, audit, text) from state q before a row, of those behind it in g: deleting, keeping and reroling."""
    to = conversations.NEXT[q]
    role = conversations.ROLES[to]
    add = lambda cost, letter, target, line: f"CASE WHEN {{0}} THEN struct_pack(c := g[{target + 1}].c + {cost}, a := '{letter}' || g[{target + 1}].a, t := {line} || CASE WHEN g[{target + 1}].t = '' THEN '' ELSE chr(10) || g[{target + 1}].t END) END"
    ways = [f"struct_pack(c := g[{q + 1}].c + 3, a := 'D' || g[{q + 1}].a, t := g[{q + 1}].t)", add("2 + extra", "R", to, f"'{role}:' || text").format("free")]
    ways += [add("extra", "K", after, "role || ':' || text").format(f"free AND role[1] = '{initial}'") for initial, steps in conversations.KEEPS.items() if (after := steps.get(q)) is not None]
    return f"list_min(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))"


def _inserted(h: str) -> str:
    """SQL for the best from each state if a row may be inserted first."""
    one = lambda q: f"least({h}[{q + 1}], struct_pack(c := {h}[{conversations.NEXT[q] + 1}].c + 2, a := 'I' || {h}[{conversations.NEXT[q] + 1}].a, t := '{conversations.ROLES[conversations.NEXT[q]]}:' || CASE WHEN {h}[{conversations.NEXT[q] + 1}].t = '' THEN '' ELSE chr(10) || {h}[{conversations.NEXT[q] + 1}].t END))"
    return "[" + ", ".join(map(one, range(4))) + "]"


_OP12 = rf"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS code FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy FROM o WHERE code <> 0),
r AS (SELECT conv_id, turn, role, text, row_number() OVER w AS i, lead(role[1]) OVER w AS after, count(*) OVER (PARTITION BY conv_id) AS n FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
a AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM r),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b' WHEN again THEN 'd' WHEN regexp_matches(text, '[^.!? 	-
]{_WHITE}*\z') THEN 't' ELSE '-' END AS fault FROM a),
x AS (SELECT *, fault NOT IN ('b', 'd') AS free, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS extra FROM f),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (after IS NOT NULL AND role[1] || after NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n FROM x GROUP BY conv_id),
p(conv_id, i, g) AS (
    SELECT conv_id, n + 1, [struct_pack(c := 0, a := '', t := ''), struct_pack(c := 4, a := 'II', t := 'user:' || chr(10) || 'assistant:'), struct_pack(c := 2, a := 'I', t := 'assistant:'), struct_pack(c := 0, a := '', t := '')] FROM s
    UNION ALL SELECT p.conv_id, p.i - 1, list_transform([[{", ".join(map(_repair_step, range(4)))}]], lambda h: list_transform([{_inserted("h")}], lambda k: {_inserted("k")})[1])[1]
    FROM p JOIN x ON p.conv_id IS NOT DISTINCT FROM x.conv_id AND p.i - 1 = x.i)
SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    coalesce(p.g[1].c, 0)::BIGINT AS cost, coalesce(p.g[1].a, '') AS audit, sha256(coalesce(p.g[1].t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN s ON q.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN p ON q.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = 1
"""

ORACLE_SQL = {"op3_ngram_jaccard_join": _OP3, "op4_url_filter": _OP4, "op5_secret_scan": _OP5, "op6_line_dedup": _OP6, "op9_decontamination": _OP9, "op11_merkle_manifest": _OP11, "op12_conversation_repair": _OP12}
