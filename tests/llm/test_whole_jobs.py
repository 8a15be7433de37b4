"""Cases where an operator once did less than its whole job."""

import random

import numpy as np

R = random.Random(11)


def test_dropout_is_drawn_for_every_occurrence(spark, monkeypatch):
    from quarry.llm import pieces

    v = pieces.Vocabulary.load()
    text = "the wonderful " * 400
    docs = spark.createDataFrame([(i, text) for i in range(12)] + [(3, text)], "doc_id long, text string")
    found = [(r.doc_id, tuple(r._ids)) for r in pieces.encoded(docs, v).collect()]
    assert len(set(found)) == 12 and len({ids for _, ids in found}) == 12
    # the occurrences of one word in one text
    own, spelled = set(), []
    for i in found[0][1]:
        if v.pieces[i].startswith("▁") and spelled:
            own.add(tuple(spelled))
            spelled = []
        spelled.append(i)
    assert len(own) > 10
    # what is shared is what each occurrence gets alone
    m = pieces.Merges.of(v)
    data = np.frombuffer(" ".join(R.choice(["the", "wonderful", "Zürich", "x▁y", "日本語", "a", "unbelievable"]) for _ in range(3000)).encode() + b" ", np.uint8)
    cut = int(np.flatnonzero(data == 32)[1000]) + 1
    args = (data, np.array([0, cut, len(data)]), np.array([-5, 9]), 0.1, 3)
    monkeypatch.setattr(pieces, "DRAWN", 100)
    shared = m.block(*args)
    monkeypatch.setattr(pieces.Merges, "touched", lambda self, own, *rest: np.arange(len(own)))
    alone = m.block(*args)
    assert all(np.array_equal(a, b) for a, b in zip(shared, alone, strict=True))


def test_quotes_of_several_paragraphs_and_inline_replies(spark):
    from quarry.llm.quotes import linked

    rows = [
        (1, 0, "Para one.\n\nPara two.\n\nPara three."), (1, 1, "> Para one.\n>\n> Para two.\nyes"), (1, 2, "> Para one.\n> \n> Para two.\n>\n> Para three.\nall"), (1, 3, "> unknown\n>\n> Para three.\n> \n> other\nno"),
        (2, 0, "a a\n\nb b"), (2, 1, "> a a\nreply one\n> b b\nreply two\n\nmore of it"), (2, 2, "> reply one\nthanks"), (2, 3, "> more of it\n\nwell\n> reply two\n>\n> more of it\nok"),
        (3, 0, "> Para two.\n>\n> Para three.\nlater"), (4, 0, "> nothing\n>\n> here"),
    ]
    found = {(r.conv_id, r.turn): (r._thread, r._reply_conv, r._reply_turn, r._quotes, r._linked) for r in linked(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert found[1, 1] == found[1, 2] == found[1, 3] == (1, 1, 0, 1, 1)
    assert found[2, 1] == (2, 2, 0, 2, 2) and found[2, 2] == (2, 2, 1, 1, 1) and found[2, 3] == (2, 2, 1, 2, 2)
    assert found[3, 0] == (1, 1, 0, 1, 1) and found[4, 0] == (4, None, None, 1, 0)


def test_edited_short_notices(spark):
    from quarry.llm.licenses import matches

    texts = {
        "Licensed under the Apache License 2.0": ["Apache-2.0"], "Licensed under BSD 3-Clause License": ["BSD-3-Clause"], "This is Licensed, under the old Apache (TM) License, as Version 2.0": ["Apache-2.0"],
        "Licensed under MIT License": ["MIT"], "Licensed under the Foo License": [], "Licensed under CC BY 3.0": [], "licensed under GNU General Public License version 3": ["GPL-3.0"],
        "Licensed under the MIT License. " * 9: ["MIT"] * 9, "license " * 30 + "Licensed under the Apache License 2.0": ["Apache-2.0"],
    }
    docs = spark.createDataFrame([(f"palaver {t} palaver", t) for t in texts], "text string, own string")
    found = {}
    for r in matches(docs).collect():
        found.setdefault(r.own, []).append(r._license)
    assert {t: found.get(t, []) for t in texts} == texts


def test_whole_licenses_and_their_notices(spark):
    from quarry.llm.license_texts import TEMPLATES, whole_texts
    from quarry.llm.licenses import matches

    whole = {name: texts[-1] for name, texts in whole_texts().items() if texts != TEMPLATES.get(name)}
    gnu = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    rows = [*whole.items(), ("AGPL-3.0", gnu.format("Affero", "3")), ("LGPL-3.0", gnu.format("Lesser", "3")), ("LGPL-2.1", gnu.format("Lesser", "2.1")), ("GPL-3.0", gnu.format("", "3"))]
    rows += [(None, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:")]
    docs = spark.createDataFrame([(i, "palaver " * 3 + t) for i, (_, t) in enumerate(rows)], "doc_id int, text string")
    found = {}
    for r in matches(docs).collect():
        found.setdefault(r.doc_id, []).append((r._license, r._coverage))
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "Unlicense", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0"} <= set(whole)
    assert found == {i: [(name, 100)] for i, (name, _) in enumerate(rows) if name}


def test_short_benchmark_items_drop_no_other_text(spark, tmp_path):
    import corpus_pipeline

    schema = "item_id string, text string"
    question = "which river runs through the old town of Bern"
    spark.createDataFrame([("a", "yes"), ("b", "of the"), ("c", "who wrote this"), ("d", "an unknown old author"), ("e", "some years ago maybe"), ("f", question)], schema).write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = {1: "yes it is one of the best", 2: "Yes, yes", 3: "x " + question + " y", 4: "who wrote this", 5: "we ask who wrote this and yes of the others", 6: "x: an unknown old author, some years ago maybe, y", 7: None, 8: "", 9: "clean text"}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    left = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 5, 7, 8, 9]


def test_symbols_of_long_turns(spark, tmp_path):
    from quarry.plans import catalogue, derived

    long = "\n".join(f"line {i}" for i in range(2500))
    spark.createDataFrame([(0, 0, "user", long), (0, 1, "bot", long), (1, 0, "user", long)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = derived.symbols(spark, str(tmp_path)).collect()
    assert len({r.symbol_id for r in found}) == len(found) == 3 * 2501 + 2
    assert {r.kind: r.n for r in catalogue.QUERIES["kinds_top12"](spark, str(tmp_path)).collect()}["line"] == 7500
    turns = {r.symbol_id: (r.file_id, r.start_row, r.end_row) for r in found if r.kind in ("user", "bot")}
    rows = {r.symbol_id: (r.file_id, r.start_row) for r in found if r.kind == "line"}
    up = {r.symbol_id: r.parent_id for r in catalogue.QUERIES["outline_parent"](spark, str(tmp_path)).collect()}
    assert all(turns[up[i]][0] == f and turns[up[i]][1] <= row <= turns[up[i]][2] for i, (f, row) in rows.items())


def test_blocks_of_a_bucket_are_dealt_out(spark):
    """Also where the bucket's rows already lie together: a plan without an exchange by (key, i, j) compares them in one task."""
    import re

    from quarry.llm import minhash as m

    at = spark.range(3000).selectExpr("1L AS key", "0 AS band", "id AS node", "id % 7 AS comp", "9L AS _n", "array(1L) AS _bands", "array(1L) AS _sketch")
    top = spark.createDataFrame([(1, 0, 12, 11)], "key long, top long, all int, few int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = m.dealt_out(at, top)
        grouped = both.groupBy(*m.GROUP).applyInArrow(lambda t: t, both.schema)
        plan = grouped._jdf.queryExecution().executedPlan().toString()
        above = plan[: plan.index("Union")]
        assert re.search(r"Exchange hashpartitioning\(key#\d+L?, i#\d+, j#\d+", above)
        assert both.groupBy(*m.GROUP).count().count() == 12 * 11
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_words_in_shared_passages(spark):
    """Of strings of 50 words that stand in another row; by definition."""
    from quarry.llm.suffix_array import deduplicated

    word = lambda: R.choice("abcdefgh") + str(R.randint(0, 400))
    passage = [word() for _ in range(61)]
    texts = [" ".join(word() for _ in range(R.randint(0, 90))).split() for _ in range(40)]
    texts += [t[:k] + passage[a:b] + t[k:] for t, k, a, b in ((texts[1], 3, 0, 61), (texts[2], 0, 0, 61), (texts[3], 5, 11, 61), (texts[4], 0, 12, 61), (texts[5], 2, 0, 50))]
    texts += [texts[40]] * 2 + [passage * 3, ["x"] * 200, ["x"] * 49, ["y"] * 120]
    rows = [(i, R.choice([" ", "\n", "  "]).join(t), "c") for i, t in enumerate(texts)] + [(900, None, "c"), (901, "", "c"), (902, "z " * 300_000, "c"), (903, "z " * 60, "c")]
    at = {}
    lists = [(t or "").split() for _, t, _ in rows]
    for i, w in enumerate(lists):
        for p in range(len(w) - 49):
            at.setdefault(tuple(w[p : p + 50]), set()).add(i)
    expected = {}
    for i, w in enumerate(lists):
        own, end = 0, 0
        for p in range(len(w) - 49):
            if len(at[tuple(w[p : p + 50])]) > 1:
                own, end = own + p + 50 - max(p, end), p + 50
        expected[rows[i][0]] = own
    found = {r.doc_id: r for r in deduplicated(spark.createDataFrame(rows, "doc_id long, text string, _words string").repartition(3), keep_text=False, passages=True).collect()}
    assert {i: r._n_shared for i, r in found.items()} == expected and all(r._words == "c" for r in found.values())
    assert sum(v > 0 for v in expected.values()) > 8 and found[903]._n_shared == 60
