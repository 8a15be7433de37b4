"""Archives, URL rules and quotations, against the definitions; and queries against their SQL."""

import hashlib
import os
import re
import subprocess
import sys
from collections import Counter

import pytest

SF = "/root/testdata/sf0.001"


def test_archives(spark, tmp_path):
    import io

    import zstandard

    from quarry.llm.warc import parsed, read_archives, write_archives

    big = "<p>" + "é" * 600 + "</p>"
    rows = [(1, "http://a/1", big, 1), (5, "http://a/5", big, 1), (5, "http://a/5", big, 1), (None, "http://a/n", big, 1), (2, None, None, 1), (3, "http://a/\n3", "", 1), (4, "u", "small", 1), (6, "u", "small", 1), (7, "u", "x" * 700_000, 1)]
    rows += [(100 + i, f"http://b/{i}", f"page {i} " * 300, 1) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, length int").repartition(3)
    folder = "file://" + str(tmp_path / "warc")
    index = write_archives(pages, folder)
    got = read_archives(index, folder, payloads=True).collect()
    assert len(got) == len(rows)
    by_id = {r[0]: (r[2] or "").encode() for r in rows}
    for r in got:
        body = by_id[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        revisit = body == big.encode() and r.page_id != 5
        assert (r.record_type, r.refers_to) == (("revisit", 5) if revisit else ("response", None))
        assert bytes(r.payload) == (b"" if revisit else body)
    # any Zstandard reader sees the records in a row, and every frame stands alone
    whole = 0
    for name in os.listdir(tmp_path / "warc"):
        if name.endswith(".zst"):
            data = (tmp_path / "warc" / name).read_bytes()
            text = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
            whole += text.count(b"WARC/1.1\r\n")
    assert whole == len(rows) and index.select("bundle", "frame").distinct().count() > index.select("bundle").distinct().count()
    assert parsed(b"WARC/1.1\r\nContent-Length: 6\r\n\r\nA\r\n\r\nB")[1] == b"B"
    assert read_archives(write_archives(pages.where("false"), folder), folder).count() == 0
    # every record has an identifier of its own, also where rows repeat an id or have none
    assert len({r.record_id for r in got}) == len(rows) == index.select("record_id").distinct().count()


def test_long_messages_and_pages(spark):
    """Quotes and links of texts of megabytes take time in proportion to their length."""
    import time

    from quarry.llm.quotes import linked
    from quarry.llm.url_filter import judged

    quoted = "\n".join(("> " if i % 3 else "") + f"line {i}" for i in range(60_000))
    rows = [(1, 0, "\n".join(f"line {i}" for i in (1, 2))), (1, 1, quoted), (2, 0, "x" * 3_000_000)]
    linked(spark.createDataFrame(rows[:1], "conv_id long, turn long, text string")).count()
    began = time.time()
    found = {(r.conv_id, r.turn): r for r in linked(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert time.time() - began < 60 and found[1, 1]._quotes == 20_000 and found[1, 1]._reply_turn == 0 and found[2, 0]._body == "x" * 3_000_000
    page = [(1, "http://a.net/" + "p" * 100_000, '<a href="http://b.net/">' * 50_000), (2, "http://b.net", None)]
    judged_ = {r.page_id: r for r in judged(spark.createDataFrame(page, "page_id long, url string, html string")).collect()}
    assert len(judged_[1].path) == 100_001 and judged_[1].verdict == "allow"
    assert judged(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_stages_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    none = docs.where("false")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in c.STAGES:
        out = stage(spark, none, str(tmp_path))
        assert out.count() == 0 and (name == c.STAGES[-1][0] or out.columns == docs.columns), name


def test_url_rules_and_trust(spark):
    from quarry.llm.url_filter import judged

    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts)
    rows = [
        (1, "http://a.example.org/es/x?q", ""), (2, "HTTP://A.Example.ORG/en/123", ""), (3, "http://example.org/fr", ""), (4, "https://notorg/x", ""), (5, "http://x.org", ""), (6, None, ""), (7, "no scheme/here", ""), (8, "http://w.com/de/", link("spam.net")), (9, "http://w.com/en/", ""),
        (10, "http://good.org/", link("friend.net")), (11, "http://friend.net/p", None), (12, "http://sp.net/p", link("bad.com")), (13, "http://bad.com/de/1", ""), (14, "http://spam.net/q#f", ""), (14, "http://spam.net/q#f", ""), (15, "http://myexample.org/es/", ""),
    ]
    found = {r.page_id: r for r in judged(spark.createDataFrame([(*r, "keep", "h") for r in rows], "page_id long, url string, html string, n string, host string")).collect()}
    assert [(found[i].host, found[i].path, found[i].rule, found[i].verdict) for i in (1, 2, 3, 5, 6, 7)] == [
        ("a.example.org", "/es/x", "example.org/es/", "block"), ("a.example.org", "/en/123", "example.org/en/1", "block"), ("example.org", "/fr", "org/", "allow"), ("x.org", "", None, found[5].verdict), ("", "", None, "allow"), ("", "", None, "allow"),
    ]
    assert found[15].rule == "org/" and found[9].verdict == "block" and found[11].verdict == "allow" and found[12].verdict == "block" and found[14].verdict == "allow" and found[4].rule is None and all(r.n == "keep" for r in found.values())


def test_quotations(spark):
    from quarry.llm.quotes import linked

    rows = [
        (1, 0, "Hello there\n\nSecond paragraph here."), (1, 1, "> Hello there\n\nAnswer one."), (1, 2, ">> hello   THERE\n> Answer one.\r\nThanks!\n> unknown"), (2, 0, "> Answer one.\nnew conversation"), (3, 0, "> new conversation\nthird"), (4, 0, None),
        (None, 1, "> third"), (5, 0, "plain"), (5, 0, "plain"), (6, 0, "> ...\nkept"), (7, 1, "> later text"), (7, 2, "later text"), (8, 0, "> plain\n" * 3),
    ]
    found = linked(spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, text string, _row string")).collect()
    assert len(found) == len(rows) and all(r._row == "x" for r in found)
    got = {(r.conv_id, r.turn): (r._thread, r._reply_conv, r._reply_turn, r._quotes, r._linked, r._body.strip()) for r in found}
    assert got[1, 1] == (1, 1, 0, 1, 1, "Answer one.") and got[1, 2] == (1, 1, 1, 3, 2, "Thanks!")
    assert got[2, 0][:3] == (1, 1, 1) and got[3, 0][:3] == (1, 2, 0) and got[4, 0] == (4, None, None, 0, 0, "")
    assert got[None, 1][0] is None and got[6, 0] == (6, None, None, 1, 0, "kept") and got[7, 1][1] is None and got[8, 0][0] == 8
    assert [r._thread for r in found if r._thread is not None] == sorted(r._thread for r in found if r._thread is not None)
    assert linked(spark.createDataFrame([], "conv_id long, turn long, text string")).count() == 0
    # the SQL says the same of these rows
    import duckdb

    from quarry.llm.queries import SQL

    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, 'r', ?)", rows)
    want = con.sql(f"SELECT thread_id, conv_id, turn, reply_conv, reply_turn, n_quotes, n_linked, body FROM ({SQL['op7_quotes']})").fetchall()
    assert Counter(want) == Counter((r._thread, r.conv_id, r.turn, r._reply_conv, r._reply_turn, r._quotes, r._linked, r._body) for r in found)


def test_components(spark):
    from quarry.llm.components import components

    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (200, 201), (201, 200), (129, 200)]
    found = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(found) == {x for e in edges for x in e} and all(found[i] == 0 for i in range(41)) and found[200] == found[129] == 100
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_against_its_parts(spark):
    """run() against brute force for each stage's decision, on the smallest tables."""
    import corpus_pipeline as c
    from quarry.llm.pieces import Vocabulary, decode
    from tests.llm.test_text_operators import kept_words, sets_of

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r.doc_id: r for r in c.run(spark, SF).collect()}
    first = c.language_id(spark, docs, SF)
    assert first.columns == docs.columns and first.count() >= 0.95 * docs.where("text IS NOT NULL").count()
    rows = {r.doc_id: r.text for r in first.collect()}
    sets = {i: sets_of(t, 5) for i, t in rows.items()}
    keep, ids = {}, sorted(rows)
    for i in ids:
        keep.setdefault(i, i)
        for j in ids:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = keep[i], keep[j]
                low = min(old, new)
                for k in keep:
                    if keep[k] in (old, new):
                        keep[k] = low
    one = [i for i in ids if keep[i] == i]
    cut = {i: kept.decode() for i, (_, _, _, kept) in zip(one, kept_words([rows[i].encode() for i in one], 50, True), strict=True)}
    words = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    windows = {tuple(w[i : i + 8]) for w in (words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()) for i in range(len(w) - 7)}
    leaks = {i for i, t in cut.items() if any(tuple(w[k : k + 8]) in windows for w in [words(t)] for k in range(len(w) - 7))}
    want = {i: t for i, t in cut.items() if i not in leaks and (t == rows[i] or t.strip())}
    v = Vocabulary.load()
    assert set(found) == set(want) and leaks and any(t != rows[i] for i, t in want.items()) and [name for name, _ in c.STAGES][0] == "language_id"
    for i, r in found.items():
        assert r.lossless and decode(r.ids, v) == want[i]


SQL_QUERIES = ["op1_suffix_array", "op2_warc", "op3_minhash", "op6_decontaminate", "op7_quotes", "op8_url_filter", "op9_repetition"]


@pytest.mark.parametrize("name", SQL_QUERIES)
def test_against_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(e.oracle_sql()[name])
    got = e.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(tuple(r[c] for c in want.columns) for r in got.collect()) == Counter(want.fetchall())


def test_every_operator_has_a_query():
    code = "import __spark_entry__ as e; names = list(e.queries()); assert all(sum(n.startswith(f'op{k}_') for n in names) == 1 for k in range(1, 11)) and 'pipeline' in names; print('ok')"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), capture_output=True, text=True).stdout.strip() == "ok"
