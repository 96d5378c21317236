"""The registered queries op1 to op13 and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, licences, mixing, ngram_join, pii, quality, secrets, sharding, simhash, spelling, urls, warc
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.quality_rules(table(spark, sf_dir, "documents")).select(*names)


def _spans(found: DataFrame, base: tuple[str, ...]) -> DataFrame:
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    basic = F.filter("spans", lambda s: s["kind"].isin(*base))
    return found.select("doc_id", *map(of, base), F.sha2(pii.digest(basic), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(pii.personal_data(table(spark, sf_dir, "documents")), pii.BASE)


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"))
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["kind"]))), ",")
    return found.select("doc_id", "n_paragraphs", F.size("spans").cast("long").alias("n_licences"), families.alias("families"), pii.digest(F.col("spans")).alias("spans"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(secrets.find_secrets(table(spark, sf_dir, "documents")), secrets.BASE)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(warc.records_of(table(spark, sf_dir, "pages")))
    headers = F.array_join(F.transform("headers", lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    return found.withColumn("headers", headers)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    turns = conversations.damaged(given)
    found = conversations.repair(turns)
    out = given.select("conv_id").distinct().alias("o").join(found.alias("f"), F.col("o.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    out = out.join(conversations.digests(turns, found).alias("d"), F.col("o.conv_id").eqNullSafe(F.col("d.conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("o.conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_rules, op2_pii, op3_mixing, op4_sharding, op5_licences, op6_secrets, op7_simhash, op8_decontamination, op9_url_filter, op10_warc_revisits, op11_conversation_repair, op12_ngram_join, op13_spelling_variants)}


def _op1_sql() -> str:
    p = quality.QualityParams()
    top = "CASE WHEN bucket < 64 THEN bucket ELSE ((bucket - (bucket // 32 - 1) * 32 + 1) << (bucket // 32 - 1)) - 1 END"
    scaled = ", ".join(f"floor({a} * {k} / greatest({b}, 1))::BIGINT AS {m}" for m, (a, b, k, *_) in quality.MEASURES.items())
    quartiles = ", ".join(f"min(CASE WHEN upto * 100 >= total * {q} THEN {top} END) AS q{q}" for q in (25, 50, 75))

    def merged(name: str, keys: str) -> str:
        k = f"{keys}, " if keys else ""
        return f"""{name} AS (SELECT {k}measure, max(total) AS total, {quartiles} FROM (
            SELECT {k}measure, bucket, sum(sum(n)) OVER (PARTITION BY {k}measure ORDER BY bucket) AS upto, sum(sum(n)) OVER (PARTITION BY {k}measure) AS total
            FROM sk GROUP BY {k}measure, bucket) GROUP BY {k}measure)"""

    pick = ", ".join(f"(o.total * o.q{q} + {p.prior} * ((l.total * l.q{q} + {p.prior} * a.q{q}) // (l.total + {p.prior}))) // (o.total + {p.prior}) AS q{q}" for q in (25, 50, 75))
    slack = "CASE measure " + " ".join(f"WHEN '{m}' THEN {v[3]}" for m, v in quality.MEASURES.items()) + " END"
    most = "CASE WHEN measure = 'word_length' THEN NULL ELSE 5000 END"
    high, low = f"least(q75 + {p.reach} * (q75 - q50) + {slack}, {most})", f"q25 - {p.reach} * (q50 - q25) - {slack}"
    limits = ", ".join([f"max(CASE WHEN measure = '{m}' THEN {high} END) AS {m}_high, max(CASE WHEN measure = '{m}' THEN {low} END) AS {m}_low" for m in quality.MEASURES])
    ok = " AND ".join([f"{m} <= coalesce({m}_high, {m})" for m in quality.MEASURES] + ["word_length >= coalesce(word_length_low, word_length)"])
    each = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS v FROM m WHERE NOT base_failed" for m in quality.MEASURES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2))),
rep AS (SELECT rid, count(DISTINCT i + d) AS n FROM win, (SELECT unnest([0, 1, 2]) AS d) WHERE n > 1 GROUP BY rid),
c AS (SELECT w.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
    FROM w LEFT JOIN rep ON w.rid = rep.rid),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {scaled} FROM c),
sk AS (SELECT lang, source, measure, CASE WHEN v < 64 THEN v ELSE (length(bin(v)) - 6) * 32 + (v >> (length(bin(v)) - 6)::INT) END AS bucket, count(*) AS n FROM ({each}) GROUP BY ALL),
{merged("o", "lang, source")}, {merged("l", "lang")}, {merged("a", "")},
f AS (SELECT lang, source, {limits} FROM (SELECT o.lang, o.source, o.measure, {pick} FROM o JOIN l ON o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure JOIN a ON o.measure = a.measure) GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {ok} AS kept
FROM m LEFT JOIN f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source"""


_OP8_SQL = r"""
WITH lower_case AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents, lower_case),
b AS (SELECT item_id, ws, least(len(ws), 10) AS k FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark, lower_case) WHERE len(ws) > 0),
g AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM b)),
dw AS (SELECT rid, k, i, array_to_string(ws[i:i + k - 1], ' ') AS gram FROM (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM g) WHERE len(ws) >= k)),
h AS (SELECT DISTINCT rid, i, dw.k, item_id FROM dw JOIN g ON dw.gram = g.gram AND dw.k = g.k),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM h) GROUP BY rid),
s AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.rid = n.rid LEFT JOIN s ON d.rid = s.rid"""


def _op9_sql() -> str:
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'n': '{h}{p}', 'v': '{v}'}}" for v, h, p in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2])))
    subs = " UNION ALL ".join(f"SELECT *, substring(shape, i, {k}) AS gram FROM (SELECT *, unnest(range(1, length(shape) - {k} + 2)) AS i FROM {{t}})" for k in range(1, urls.ORDER + 1))
    levels = []
    for k in range(1, urls.ORDER + 1):
        q = lambda c, k=k: "1 / 256" if k == 1 else f"l.p_{c}"
        p = lambda c, q=q: f"CASE WHEN n_{c} > 0 THEN ({c} + t_{c} * ({q(c)})) / (n_{c} + t_{c}) ELSE {q(c)} END"
        gain = lambda c, q=q: f"CASE WHEN {c} > 0 THEN ln(p_{c} / (back_{c} * q_{c})) ELSE 0 END"
        levels.append(f"""l{k} AS (SELECT gram, p_yes, p_no, ({gain("yes")}) - ({gain("no")}) AS w FROM (SELECT g.*, {p("yes")} AS p_yes, {p("no")} AS p_no, {q("yes")} AS q_yes, {q("no")} AS q_no
            FROM gc g {f"JOIN l{k - 1} l ON l.gram = substring(g.gram, 2)" if k > 1 else ""} WHERE length(g.gram) = {k}))""")
    unions = " UNION ALL ".join(f"SELECT gram, w FROM l{k}" for k in range(1, urls.ORDER + 1))
    return rf"""
WITH a AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages),
b AS (SELECT page_id, translate(regexp_extract(after, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r AS (SELECT *, CASE {fits} END AS r, chr(2) || regexp_replace(host || path, '[0-9]+', '0', 'g') || chr(3) AS shape FROM b),
s AS (SELECT shape, count(*) FILTER (r.v = 'allow') AS yes, count(*) FILTER (r.v = 'block') AS no, ('0x' || left(md5(shape), 6))::BIGINT % {urls.FOLDS} AS fold FROM r GROUP BY shape),
f AS (SELECT * FROM s WHERE fold > 0 AND yes + no > 0),
g AS (SELECT gram, left(gram, length(gram) - 1) AS context, sum(yes) AS yes, sum(no) AS no FROM ({subs.format(t="f")}) GROUP BY gram),
c AS (SELECT *, CASE WHEN n_yes > 0 THEN t_yes / (n_yes + t_yes) ELSE 1 END AS back_yes, CASE WHEN n_no > 0 THEN t_no / (n_no + t_no) ELSE 1 END AS back_no
    FROM (SELECT context, sum(yes) AS n_yes, count(*) FILTER (yes > 0) AS t_yes, sum(no) AS n_no, count(*) FILTER (no > 0) AS t_no FROM g GROUP BY context)),
gc AS (SELECT * FROM g JOIN c USING (context)),
{", ".join(levels)},
w AS (SELECT gram, round(sum(w) * {urls.UNIT})::BIGINT AS w FROM ({unions} UNION ALL SELECT context, ln(back_yes) - ln(back_no) FROM c) GROUP BY gram),
z AS (SELECT shape, sum(coalesce(w, 0)) AS total FROM ({subs.format(t="s")}) LEFT JOIN w USING (gram) GROUP BY shape),
x AS (SELECT s.*, floor((total + coalesce((SELECT w FROM w WHERE gram = ''), 0) * length(shape)) / (length(shape) * {urls.BIN})) AS ratio FROM s JOIN z USING (shape)),
t AS (SELECT ratio, sum(yes) AS yes, sum(no) AS no FROM x WHERE fold = 0 AND yes + no > 0 GROUP BY ratio),
u AS (SELECT ratio, coalesce(sum(no) OVER b, 0) / nullif(sum(no) OVER (), 0) - coalesce(sum(yes) OVER b, 0) / nullif(sum(yes) OVER (), 0) AS gain FROM t WINDOW b AS (ORDER BY ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
line AS (SELECT coalesce((SELECT ratio FROM u WHERE gain IS NOT NULL ORDER BY gain DESC, abs(ratio), ratio LIMIT 1), 0) AS line)
SELECT page_id, host, path, r.n AS rule, coalesce(r.v, CASE WHEN ratio >= line THEN 'allow' ELSE 'block' END) AS verdict FROM r JOIN x USING (shape), line"""


_OP10_SQL = rf"""
WITH b AS (SELECT page_id, url, length(html) AS n, '"' || md5(html) || '"' AS tag, coalesce(('0x' || left(md5(url), 6))::BIGINT, 0) % 1000 AS h FROM pages),
p AS (SELECT *, CASE WHEN h % 7 <> 0 THEN tag END AS etag, CASE WHEN h % 3 <> 0 THEN 'day ' || n END AS modified, regexp_replace(url, '#.*$', '') AS bare FROM b),
q AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)), '^(http://.*):80$', ''), '^(https://.*):443$', '') AS head,
    regexp_extract(bare, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?]*)?([^?]*)', 1) AS path, list_sort([x for x in string_split(regexp_extract(bare, '\?(.*)$', 1), '&') if x <> '' AND NOT regexp_matches(x, '^utm_')]) AS query FROM p),
c AS (SELECT *, head || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END AS canonical_url FROM q),
full_ AS (SELECT page_id * 2 AS record_id, page_id * 10 AS ts, canonical_url, etag, modified, n FROM c),
revisit AS (SELECT page_id * 2 + 1 AS record_id, page_id, page_id * 10 + h * 100 AS ts, canonical_url, etag, modified, h FROM c),
m AS (SELECT r.record_id, r.page_id, r.canonical_url, r.ts, r.etag, r.modified, r.h, f.record_id AS response_id, f.ts AS response_ts, f.etag AS f_etag, f.modified AS f_modified, f.n,
    row_number() OVER (PARTITION BY r.record_id ORDER BY f.ts DESC, f.record_id DESC) AS k
    FROM revisit r LEFT JOIN full_ f ON r.canonical_url = f.canonical_url AND (f.ts < r.ts OR f.ts = r.ts AND f.record_id < r.record_id)),
o AS (SELECT *, coalesce(etag = f_etag, modified = f_modified) AS same FROM m WHERE k = 1)
SELECT record_id, canonical_url, ts, response_id, response_ts, CASE WHEN response_id IS NULL THEN 'missing' WHEN same IS NULL THEN 'unchecked' WHEN same THEN 'confirmed' ELSE 'changed' END AS outcome,
    CASE WHEN response_id IS NOT NULL AND coalesce(same, true) THEN 'age=' || h || '; content-length=' || n || '; content-type=text/html; date=' || page_id END AS headers FROM o"""


#: The 256 remainders of the CRC-32 as a list, by its rule.
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, e: xor(c >> 1, (c & 1) * 3988292384))) AS crc_table)"


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of the UTF-8 bytes of an expression; the query joins `crc`."""
    octets = f"list_transform(range(1, 2 * octet_length(encode({text})), 2), lambda k: ('0x' || substr(hex(encode({text})), k, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])))"


def _op11_sql() -> str:
    edit = lambda x, letter, cost, row: f"{{'c': {x}.c + {cost}, 'a': '{letter}' || {x}.a, 'r': {row}{x}.r}}"
    role = {2: "user", 3: "assistant"}
    into = lambda x, q: edit(x, "I", 2, f"chr(10) || '{role[q]}:' || ")
    first = lambda options: f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1]"
    b = [f"b[{k}]" for k in (1, 2, 3, 4)]
    settled = [first([b[0], into(b[2], 2), into(f"({into(b[3], 3)})", 2)]), first([b[1], into(b[2], 2), into(f"({into(b[3], 3)})", 2)]), first([b[2], into(b[3], 3)]), first([b[3], into(b[2], 2)])]
    settle = f"[{', '.join(settled)}]"
    plain = []
    for q in range(4):
        v, made = f"v[{q + 1}]", conversations.MADE[q]
        other = edit(f"v[{made + 1}]", "R", "2 + late", f"chr(10) || '{role[made]}:' || text || ")
        kept = [f"CASE WHEN stays AND c = '{c}' THEN {edit(f'v[{to + 1}]', 'K', 'late', 'chr(10) || role || chr(58) || text || ')} END" for (state, c), to in conversations.KEPT.items() if state == q]
        plain.append(first([edit(v, "D", 3, ""), f"CASE WHEN stays THEN {other} END", *kept]))
    end = "{'c': 0, 'a': '', 'r': ''}"
    never = "{'c': 1000000000, 'a': '', 'r': ''}"
    return rf"""
WITH RECURSIVE {_CRC_TABLE},
g AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS h FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy FROM g WHERE h <> 0),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS z FROM d),
f AS (SELECT *, left(role, 1) AS c, CASE WHEN z = '' THEN 1 WHEN seen > 1 THEN 2 WHEN z NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) AS i FROM s),
r AS (SELECT *, (fault = 3)::INT AS late, fault NOT IN (1, 2) AS stays, lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM f),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS rows_ FROM r GROUP BY conv_id),
t AS (SELECT conv_id, rows_ + 1 AS i, {settle} AS v FROM (SELECT *, [{end}, {never}, {never}, {end}] AS b FROM n)
    UNION ALL SELECT conv_id, i, {settle} FROM (SELECT r.conv_id, r.i, [{", ".join(plain)}] AS b FROM t JOIN r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.i = t.i - 1))
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
    coalesce(v[1].c, 0)::BIGINT AS cost, coalesce(v[1].a, '') AS audit, sha256(coalesce(substr(v[1].r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN n ON o.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN (SELECT * FROM t WHERE i = 1) t ON o.conv_id IS NOT DISTINCT FROM t.conv_id"""


_OP12_SQL = r"""
WITH RECURSIVE lower_case AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x20\x09-\x0D]+') AS ws FROM documents, lower_case),
s AS (SELECT rid, doc_id, list_distinct([array_to_string(ws[i:i + least(len(ws), 5) - 1], ' ') for i in range(1, greatest(len(ws) - 3, 2)) if len(ws) > 0]) AS grams FROM w),
d AS (SELECT md5(array_to_string(list_sort(grams), chr(10))) AS set_id, any_value(grams) AS grams, min(doc_id) AS least_id FROM s WHERE len(grams) > 0 GROUP BY 1),
g AS (SELECT set_id, len(grams) AS n, unnest(grams) AS gram FROM d),
p AS (SELECT x.set_id AS a, y.set_id AS b FROM g x JOIN g y ON x.gram = y.gram AND x.set_id <> y.set_id GROUP BY x.set_id, y.set_id HAVING 100 * count(*) >= 80 * (max(x.n) + max(y.n) - count(*))),
r AS (SELECT set_id AS a, set_id AS b FROM d UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS set_id, min(least_id) AS component_id FROM r JOIN d ON r.b = d.set_id GROUP BY a)
SELECT doc_id, len(grams)::BIGINT AS n_shingles, CASE WHEN len(grams) > 0 THEN component_id ELSE doc_id END AS component_id
FROM s LEFT JOIN c ON c.set_id = md5(array_to_string(list_sort(grams), chr(10)))"""


def _op13_sql() -> str:
    return rf"""
WITH RECURSIVE {_CRC_TABLE},
a AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
b AS (SELECT doc_id, w, count(*) AS n FROM a GROUP BY ALL),
h AS (SELECT w, n, {_crc32("(coalesce(doc_id::VARCHAR, '') || ':' || w)")} AS h FROM b, crc),
v AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % {spelling.DAMAGE} = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM h) WHERE length(word) >= {spelling.MIN_LENGTH} GROUP BY word HAVING sum(n) >= {spelling.MIN_COUNT}),
d AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS less FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT x.word, y.word AS near, y.n FROM d x JOIN d y ON x.less = y.less AND x.i = y.i AND x.word <> y.word
    UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.less = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.less = v.word),
q AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS best, max(n) AS best_n FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 2 * v.n THEN best END AS form, CASE WHEN best_n >= 2 * v.n THEN best_n END AS form_n FROM v LEFT JOIN q ON v.word = q.word),
r AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON r.next = f.word)
SELECT f.word, f.form, r.at AS root, f.n, f.n_near, f.form_n FROM f JOIN r ON f.word = r.word WHERE r.next IS NULL"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _op1_sql(), "op8_decontamination": _OP8_SQL, "op9_url_filter": _op9_sql(), "op10_warc_revisits": _OP10_SQL, "op11_conversation_repair": _op11_sql(), "op12_ngram_join": _OP12_SQL, "op13_spelling_variants": _op13_sql()}
