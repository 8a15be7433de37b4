"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_array import deduplicated

    found = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False, passages=True)
    return found.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"), F.col("_sha").alias("kept_sha256"), F.col("_n_shared").alias("n_shared_words"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_suffix_array": op1_suffix_array}
SQL: dict[str, str] = {}
# bytes are spelled in hexadecimal, two digits for each, so that windows are substrings
SQL["op1_suffix_array"] = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, p, md5_number(substring(h, 2 * p + 1, 800)) AS m FROM (SELECT rid, h, unnest(range(n - 399)) AS p FROM d WHERE n >= 400)),
rep AS (SELECT rid, p FROM w QUALIFY count(*) OVER (PARTITION BY m) > 1),
far AS (SELECT rid, p, max(p + 400) OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM rep),
runs AS (SELECT rid, p, sum(CASE WHEN e IS NULL OR p > e THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY p) AS k FROM far),
spans AS (SELECT rid, min(p) AS a, max(p) + 400 AS b FROM runs GROUP BY rid, k),
gaps AS (
  SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM spans
  UNION ALL SELECT d.rid, n, n, coalesce(m, 0) FROM d LEFT JOIN (SELECT rid, max(b) AS m FROM spans GROUP BY rid) t ON t.rid = d.rid),
kept AS (SELECT d.rid, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS h FROM gaps JOIN d ON d.rid = gaps.rid GROUP BY d.rid),
removed AS (SELECT rid, sum(b - a) AS r, count(*) AS s FROM spans GROUP BY rid),
t AS (SELECT rid, list_filter(regexp_split_to_array(decode(unhex(h)), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM d),
passage AS (SELECT rid, p, md5_number(array_to_string(words[p:p + 49], ' ')) AS m FROM (SELECT rid, words, unnest(range(1, len(words) - 48)) AS p FROM t WHERE len(words) >= 50)),
shared AS (SELECT rid, p FROM passage QUALIFY min(rid) OVER (PARTITION BY m) <> max(rid) OVER (PARTITION BY m)),
covered AS (SELECT rid, count(DISTINCT q) AS w FROM (SELECT rid, unnest(range(p, p + 50)) AS q FROM shared) GROUP BY rid)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, CAST(coalesce(s, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256,
  CAST(coalesce(w, 0) AS BIGINT) AS n_shared_words
FROM d JOIN kept ON kept.rid = d.rid LEFT JOIN removed ON removed.rid = d.rid LEFT JOIN covered ON covered.rid = d.rid
"""


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import with_components

    return with_components(table(spark, sf_dir, "documents").select("doc_id", "text"), n=4)


QUERIES["op3_minhash"] = op3_minhash
SQL["op3_minhash"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS sh
  FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, m AS component_id, s.doc_id = m AS kept FROM s JOIN comp ON comp.a = s.doc_id
"""


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    found = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("_hit", F.lit(0).cast("long"), lambda a, x: a + x.end - x.start)
    return found.select(
        "doc_id", F.col("_n").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"), F.col("_bad").alias("contaminated"),
    )


QUERIES["op6_decontaminate"] = op6_decontaminate
SQL["op6_decontaminate"] = r"""
WITH split AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark WHERE item_id IS NOT NULL),
w AS (
  SELECT kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM split),
item AS (
  SELECT DISTINCT id, least(len(words), 8) AS k, unnest(list_transform(range(1, greatest(len(words) - 7, 1) + 1), lambda i: array_to_string(words[i:i + 7], ' '))) AS win
  FROM w WHERE kind = 'b' AND len(words) > 0),
d AS (
  SELECT id, words, k, unnest(range(1, len(words) - k + 2)) AS p FROM w, (SELECT DISTINCT k FROM item) WHERE kind = 'd' AND len(words) >= k),
hit AS (SELECT d.id, d.p, d.k, item.id AS item FROM d JOIN item ON item.k = d.k AND item.win = array_to_string(d.words[d.p:d.p + d.k - 1], ' ')),
pos AS (SELECT id, count(DISTINCT q) AS n FROM (SELECT id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY id),
its AS (SELECT id, count(*) AS n, string_agg(CAST(item AS VARCHAR), ',' ORDER BY CAST(item AS VARCHAR)) AS s FROM (SELECT DISTINCT id, item FROM hit) GROUP BY id)
SELECT w.id AS doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(its.s, '')) AS items_sha256, coalesce(its.n, 0) >= 2 AS contaminated
FROM w LEFT JOIN pos ON pos.id = w.id LEFT JOIN its ON its.id = w.id WHERE kind = 'd'
"""


def op9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repetition import judged

    return judged(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES["op9_repetition"] = op9_repetition
SQL["op9_repetition"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM t),
win AS (
  SELECT doc_id, k, p, array_to_string(words[p:p + k - 1], ' ') AS g
  FROM (SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS p FROM w, (SELECT unnest(range(5, 11)) AS k) WHERE len(words) >= k)),
dup AS (SELECT doc_id, k, p, row_number() OVER (PARTITION BY doc_id, k, g ORDER BY p) > 1 AS again FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k, g) > 1),
cov AS (SELECT DISTINCT doc_id, k, unnest(range(p, p + k)) AS q FROM dup WHERE again UNION ALL SELECT DISTINCT doc_id, 0, unnest(range(p, p + k)) FROM dup WHERE k = 8),
share AS (
  SELECT w.doc_id, count(*) FILTER (k = 0) AS n_repeat, sum(length(words[q])) FILTER (k = 5) AS c5, sum(length(words[q])) FILTER (k = 6) AS c6, sum(length(words[q])) FILTER (k = 7) AS c7,
    sum(length(words[q])) FILTER (k = 8) AS c8, sum(length(words[q])) FILTER (k = 9) AS c9, sum(length(words[q])) FILTER (k = 10) AS c10
  FROM cov JOIN w ON w.doc_id = cov.doc_id GROUP BY w.doc_id),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t),
lines AS (
  SELECT doc_id, CAST(sum(n - 1) AS BIGINT) AS n_dup, sum((n - 1) * length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g'))) AS c
  FROM (SELECT doc_id, l, count(*) AS n FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id, l) GROUP BY doc_id),
f AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(lines.n_dup, 0) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
    coalesce(lines.c, 0) AS cl, coalesce(c5, 0) AS c5, coalesce(c6, 0) AS c6, coalesce(c7, 0) AS c7, coalesce(c8, 0) AS c8, coalesce(c9, 0) AS c9, coalesce(c10, 0) AS c10
  FROM w LEFT JOIN share ON share.doc_id = w.doc_id LEFT JOIN lines ON lines.doc_id = w.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (100 * cl > 20 * word_chars OR 100 * c5 > 15 * word_chars OR 100 * c6 > 14 * word_chars OR 100 * c7 > 13 * word_chars
    OR 100 * c8 > 12 * word_chars OR 100 * c9 > 11 * word_chars OR 100 * c10 > 10 * word_chars) AS kept
FROM b
"""


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import held_out, identified, trained

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = trained(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    found = identified(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


QUERIES["op5_language"] = op5_language


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import Vocabulary, encoded

    found = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), Vocabulary.load(), ids=False)
    return found.select("doc_id", F.col("_n").alias("n_ids"), F.col("_sha").alias("ids_sha256"), F.col("_lossless").alias("lossless"))


QUERIES["op10_pieces"] = op10_pieces


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_folder, read_archives, write_archives

    folder = archive_folder(spark)
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(index, folder).drop("record_id")


QUERIES["op2_warc"] = op2_warc
SQL["op2_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS first FROM p WHERE octet_length(encode(html)) >= 1000 GROUP BY html)
SELECT p.page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN g.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN g.first <> p.page_id THEN g.first END AS refers_to
FROM p LEFT JOIN g ON g.html = p.html
"""


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judged

    return judged(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def _url_sql() -> str:
    """The fixed number of rounds written out as that many steps."""
    from .url_filter import DAMPING, RATIO, ROUNDS, RULES, UNIT

    fits = "\n".join(f"  WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p} {v}'" for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
    steps = "".join(
        f"m{k + 1} AS (SELECT host, kind, CAST(sum(mass) AS BIGINT) AS mass FROM (SELECT dst AS host, m.kind, mass * {DAMPING} // 100 * n // total AS mass FROM m{k} m JOIN e ON e.kind = m.kind AND e.src = m.host "
        f"UNION ALL SELECT host, kind, seed FROM seeds) GROUP BY host, kind),\n"
        for k in range(ROUNDS)
    )
    return rf"""
WITH p AS (
  SELECT page_id, html, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE
{fits} END AS fit FROM p),
l AS (
  SELECT src, dst, count(*) AS n FROM (
    SELECT host AS src, translate(regexp_extract(unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?\s*((?:https?:)?//[^"''\s>]+)', 1)), '//([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst
    FROM r WHERE host <> '') WHERE dst <> '' AND dst <> src GROUP BY src, dst),
b AS (SELECT 'trust' AS kind, src, dst, n FROM l UNION ALL SELECT 'distrust', dst, src, n FROM l),
e AS (SELECT *, CAST(sum(n) OVER (PARTITION BY kind, src) AS BIGINT) AS total FROM b),
c AS (SELECT host, count(*) AS n, count(*) FILTER (fit LIKE '% allow') AS a, count(*) FILTER (fit LIKE '% block') AS b FROM r WHERE host <> '' GROUP BY host),
seeds AS (SELECT host, 'trust' AS kind, {UNIT} * a // n AS seed FROM c WHERE {UNIT} * a // n > 0 UNION ALL SELECT host, 'distrust', {UNIT} * b // n FROM c WHERE {UNIT} * b // n > 0),
m0 AS (SELECT host, kind, seed AS mass FROM seeds),
{steps}bad AS (SELECT host FROM m{ROUNDS} GROUP BY host HAVING 100 * coalesce(sum(mass) FILTER (kind = 'distrust'), 0) > {RATIO} * coalesce(sum(mass) FILTER (kind = 'trust'), 0))
SELECT page_id, r.host, path, split_part(fit, ' ', 1) AS rule, coalesce(split_part(fit, ' ', 2), CASE WHEN bad.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN bad ON bad.host = r.host
"""


QUERIES["op8_url_filter"] = op8_url_filter
SQL["op8_url_filter"] = _url_sql()


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import matches

    found = matches(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *(F.col(f"_{c}").alias(c) for c in ("license", "matched", "template_words", "first_word", "last_word", "start", "end", "coverage")))


QUERIES["op4_licenses"] = op4_licenses


def _quotes_sql(messages: str) -> str:
    """Whole quoted passages and their paragraphs against whole messages, their unquoted runs and the paragraphs of both."""
    split, norm = r"string_split_regex({}, '\n[ \t\r]*\n')", r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    return rf"""
WITH RECURSIVE messages AS ({messages}),
m AS (SELECT *, row_number() OVER () AS rid FROM messages),
l AS (SELECT rid, c, t, unnest(a) AS x, generate_subscripts(a, 1) AS k FROM (SELECT rid, conv_id AS c, turn AS t, string_split_regex(coalesce(text, ''), '\r?\n') AS a FROM m)),
p AS (SELECT rid, c, t, k, length(regexp_replace(regexp_extract(x, '^((?:[ \t]{{0,3}}>)+)[ \t]?', 1), '[^>]', '', 'g')) AS level, regexp_replace(x, '^((?:[ \t]{{0,3}}>)+)[ \t]?', '') AS line FROM l),
b AS (SELECT rid, max(level) > 0 AS quoting, string_agg(line, chr(10) ORDER BY k) FILTER (level = 0) AS body FROM p GROUP BY rid),
body AS (SELECT m.rid, conv_id, turn, role, quoting, CASE WHEN quoting THEN coalesce(b.body, '') ELSE coalesce(text, '') END AS body FROM m JOIN b ON b.rid = m.rid),
g AS (SELECT *, k - row_number() OVER (PARTITION BY rid, level ORDER BY k) AS island FROM p),
runs AS (SELECT rid, c, t, level, island, string_agg(line, chr(10) ORDER BY k) AS x FROM g GROUP BY rid, c, t, level, island),
q AS (SELECT * FROM runs WHERE level > 0),
pieces AS (SELECT *, 0 AS part FROM q UNION ALL SELECT rid, c, t, level, island, unnest(a), 1 FROM (SELECT *, {split.format("x")} AS a FROM q) WHERE len(a) > 1),
pn AS (SELECT rid, c, t, level, island, part, {norm.format("x")} AS n FROM pieces),
parts AS (
  SELECT conv_id AS c, turn AS t, unnest([body] || {split.format("body")}) AS x FROM body
  UNION ALL SELECT r.c, r.t, unnest([x] || {split.format("x")}) FROM runs r JOIN body ON body.rid = r.rid AND quoting WHERE level = 0),
own AS (SELECT c, t, {norm.format("x")} AS n FROM parts WHERE c IS NOT NULL AND t IS NOT NULL),
near AS (SELECT n, c, min(t) AS near FROM own WHERE n <> '' GROUP BY n, c),
far AS (SELECT n, min(c) AS fc, arg_min(near, c) AS ft FROM near GROUP BY n),
f AS (
  SELECT pn.*, CASE WHEN near < t THEN pn.c WHEN fc < pn.c THEN fc END AS tc, CASE WHEN near < t THEN near WHEN fc < pn.c THEN ft END AS tt
  FROM pn LEFT JOIN near ON near.n = pn.n AND near.c = pn.c LEFT JOIN far ON far.n = pn.n),
bq AS (SELECT rid, c, level, island, tc, tt, length(n) AS size FROM f WHERE tc IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rid, level, island ORDER BY part, length(n) DESC, tc, tt) = 1),
best AS (SELECT rid, c, tc, tt FROM bq QUALIFY row_number() OVER (PARTITION BY rid ORDER BY level, size DESC, tc, tt) = 1),
sums AS (SELECT q.rid, count(*) AS nq, count(bq.tc) AS nl FROM q LEFT JOIN bq ON bq.rid = q.rid AND bq.level = q.level AND bq.island = q.island GROUP BY q.rid),
up AS (SELECT c, min(tc) AS up FROM best WHERE tc < c GROUP BY c),
chain AS (SELECT c, up FROM up UNION ALL SELECT chain.c, up.up FROM chain JOIN up ON up.c = chain.up),
root AS (SELECT c, min(up) AS root FROM chain GROUP BY c)
SELECT coalesce(root, conv_id) AS thread_id, conv_id, turn, role, tc AS reply_conv, tt AS reply_turn, coalesce(nq, 0) AS n_quotes, coalesce(nl, 0) AS n_linked, body
FROM body LEFT JOIN sums ON sums.rid = body.rid LEFT JOIN best ON best.rid = body.rid LEFT JOIN root ON root.c = conv_id
"""


SQL["op7_quotes"] = _quotes_sql("SELECT conv_id, turn, role, text FROM conversations")


def _threaded(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("_thread").alias("thread_id"), "conv_id", "turn", "role", F.col("_reply_conv").alias("reply_conv"), F.col("_reply_turn").alias("reply_turn"),
        F.col("_quotes").alias("n_quotes"), F.col("_linked").alias("n_linked"), F.col("_body").alias("body"),
    )


def op7_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quotes import linked

    return _threaded(linked(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


QUERIES["op7_quotes"] = op7_quotes
#: What a message quotes above its own text: every fifth turn the one before it, every fifth other the paragraphs of the one
#: before, with a line of its own between them and one level deeper, and a third of first turns the conversation before.
QUOTING = r"""
SELECT m.conv_id, m.turn, m.role, CASE
  WHEN m.turn % 5 = 1 AND b.text IS NOT NULL THEN '> ' || replace(b.text, chr(10), chr(10) || '> ') || chr(10) || coalesce(m.text, '')
  WHEN m.turn % 5 = 3 AND b.text IS NOT NULL THEN '>> ' || replace(b.text, chr(10), chr(10) || '>> ') || chr(10) || 'so it is' || chr(10) || '> unheard of' || chr(10) || '>' || chr(10) || '> ' || split_part(b.text, chr(10), 1) || chr(10) || coalesce(m.text, '')
  WHEN m.turn = 0 AND m.conv_id % 3 = 1 AND a.text IS NOT NULL THEN '> ' || replace(a.text, chr(10), chr(10) || '> ') || chr(10) || coalesce(m.text, '')
  ELSE m.text END AS text
FROM conversations m LEFT JOIN (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY conv_id, turn) b ON b.conv_id = m.conv_id AND b.turn = m.turn - 1
LEFT JOIN (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY conv_id, turn) a ON a.conv_id = m.conv_id - 1 AND a.turn = m.turn"""


def quoted_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given conversations with quotes in them, linked."""
    from .quotes import linked

    own = spark.sql(QUOTING.replace("chr(10)", "char(10)").replace("FROM conversations", "FROM {conversations}"), conversations=table(spark, sf_dir, "conversations"))
    return _threaded(linked(own))


QUERIES["quoted_replies"] = quoted_replies
SQL["quoted_replies"] = _quotes_sql(QUOTING)


def op11_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("item", "item_id")


QUERIES["op11_block_max"] = op11_block_max
SQL["op11_block_max"] = r"""
WITH b AS (SELECT row_number() OVER () AS q, item_id, text FROM benchmark),
d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
dt AS (SELECT rid, doc_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM d),
bt AS (SELECT q, item_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM b),
tf AS (SELECT rid, doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
s AS (SELECT count(DISTINCT rid) AS n_docs, CAST(count(*) AS BIGINT) AS n_terms FROM dt),
m AS (SELECT rid, 75 + (25 * count(*) * any_value(n_docs)) // any_value(n_terms) AS m FROM dt, s GROUP BY rid),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term),
x AS (
  SELECT q, item_id, tf.rid, tf.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS score
  FROM bt JOIN tf ON tf.term = bt.term JOIN m ON m.rid = tf.rid JOIN w ON w.term = bt.term GROUP BY q, item_id, tf.rid, tf.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score
FROM x WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) <= 20
"""


def op12_neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import LEAST_SCORE, fitted, held_out, scored

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    space = fitted(docs, table(spark, sf_dir, "labels"), learn=~held_out())
    return scored(docs, space).select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= LEAST_SCORE).cast("int").alias("predicted"))


QUERIES["op12_neighbour_votes"] = op12_neighbour_votes


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audited, masks

    return audited(masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


QUERIES["op13_filter_audit"] = op13_filter_audit
# step by step over every document, instead of differences of subsets
SQL["op13_filter_audit"] = r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM t),
lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT rid, part, coalesce(quality, 0) = 1 AS good, coalesce(toxic, 0) = 1 AS bad,
    concat(CASE WHEN len(words) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' END,
      CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 'C' END, CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
      CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY text) THEN 'E' END) AS fails
  FROM w LEFT JOIN lab ON lab.doc_id = w.doc_id),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS toxic FROM f GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT x AS o FROM l UNION ALL SELECT o || x FROM o JOIN l ON NOT contains(o, x)),
s AS (SELECT o.o, k, substring(o.o, k, 1) AS x, substring(o.o, 1, k - 1) AS before FROM o, unnest(range(1, 6)) AS r(k) WHERE length(o.o) = 5),
a AS (
  SELECT part, s.o, k, x, n, good, toxic, contains(fails, x) AS hit, fails = x AS only_,
    EXISTS (SELECT 1 FROM l WHERE contains(before, l.x) AND contains(fails, l.x)) AS gone
  FROM g, s),
r AS (
  SELECT part, o, k, x, coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND hit), 0) AS removed, coalesce(sum(n) FILTER (gone AND hit), 0) AS redundant,
    coalesce(sum(n) FILTER (only_), 0) AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND hit), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND hit), 0) AS toxic_lost
  FROM a GROUP BY part, o, k, x)
SELECT part, o AS filter_order, CAST(k AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM r
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
