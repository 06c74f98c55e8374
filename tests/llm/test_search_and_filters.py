"""Operators 2, 3, 4, 8 and 9 on small inputs, against plain Python."""

import fnmatch
import json

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from newsloom.llm import ann, chat_tools, license_scan, url_filter, warc


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, label string, score double")


def test_license_places_and_labels(spark):
    long_text = "x " * 5000 + "Released under the MIT License. " + "y " * 5000
    rows = [
        (1, "Licensed under the Apache License, Version 2.0.", "a", 1.0),
        (2, "under the MIT license under the mit LICENSE", "a", 1.0),
        (3, None, None, None),
        (4, "", "", 0.0),
        (5, long_text, "b", 2.0),
        (None, "All rights reserved.", None, None),
        (6, "This work is licensed under the GNU General Public License, version 3.", "c", 1.0),
        (6, "This work is licensed under the GNU General Public License, version 3.", "c", 1.0),
    ]
    out = [r.asDict() for r in license_scan.scan_licenses(docs(spark, rows)).collect()]
    by = {r["doc_id"]: r for r in out}
    assert len(out) == 8
    assert by[1]["base_labels"] == by[1]["labels"] == "apache-2" and by[1]["first_word"] == 3 == by[1]["last_word"]
    assert (by[2]["n_base"], by[2]["first_word"], by[2]["last_word"], by[2]["n_words"]) == (2, 0, 4, 8)
    assert by[3]["n_words"] == 0 and by[3]["first_word"] is None and by[3]["labels"] == "" and by[3]["score"] == 0
    assert by[5]["base_labels"] == "mit" and by[5]["first_word"] == 5001
    assert by[None]["labels"] == "all-rights-reserved" and by[None]["base_labels"] == ""
    assert by[6]["labels"] == "gpl-3" and by[6]["score"] == 1.0


def test_license_join_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["the", "license", "under", "mit", "gnu", "public", "rights", "all", "reserved", "zz", "qq", "general"]
    rows = [(i, "\n".join(" ".join(rng.choice(vocabulary, rng.integers(0, 12))) for _ in range(3)), None, None) for i in range(120)]
    rows.append((500, " ".join(rng.choice(vocabulary, 700)), None, None))
    templates = (("a", "all rights reserved under the mit license"), ("b", "gnu general public license"), ("c", "zz"))
    got = {(r.doc_id, r.label, round(r.containment, 9)) for r in license_scan.template_links(docs(spark, rows), "doc_id", templates=templates, containment=0.7).collect()}
    expected = set()
    for i, text, _, _ in rows:
        for line in [*text.split("\n"), text]:
            own = line.split()
            n = len(own)
            starts = [0] if n <= 128 else range(0, n - 64, 64)
            for s in starts if n else []:
                block = set(own[s : s + 128])
                for label, t in templates:
                    words = set(t.split())
                    if len(words & block) / len(words) >= 0.7:
                        expected.add((i, label, round(len(words & block) / len(words), 9)))
    assert got == expected


def test_license_headers_wrapped_over_lines(spark):
    headers = {
        "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell""",
        "bsd": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:""",
        "gpl": """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or""",
        "mpl-2": """# This Source Code Form is subject to the terms of the Mozilla Public
# License, v. 2.0. If a copy of the MPL was not distributed with this
# file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        "apache-2": """// you may not use this file except in compliance with the License.\r
// You may obtain a copy of the License at\r
//\r
//     http://www.apache.org/licenses/LICENSE-2.0""",
    }
    far = "\n".join(f"line {i} of a file" for i in range(50))
    rows = [(i, t, None, None) for i, t in enumerate([*headers.values(), *(f"{far}\n{t}\n{far}" for t in headers.values())])]
    got = {r.doc_id: (r.labels, r.score, r.base_labels) for r in license_scan.scan_licenses(docs(spark, rows)).collect()}
    assert got == {i: (label, 1.0, "") for i, label in enumerate([*headers, *headers])}


def test_license_line_spread_wide_is_still_found(spark):
    line = "all " + "x " * 60 + "rights " + "x " * 62 + "reserved"  # 125 words: one line, but no window of the text
    got = license_scan.scan_licenses(docs(spark, [(1, "y " * 64 + "\n" + line + "\n" + "y " * 64, None, None)])).collect()
    assert [(r.labels, r.score) for r in got] == [("all-rights-reserved", 1.0)]


def test_license_windows_grow_with_the_longest_template(spark):
    long = " ".join(f"word{i}" for i in range(150))
    text = "x " * 100 + long.replace("word75 ", "word75\n") + " y" * 500
    got = license_scan.scan_licenses(docs(spark, [(1, text, None, None)]), templates=(("long", long),), containment=1.0).collect()
    assert [(r.labels, r.score) for r in got] == [("long", 1.0)]


def test_license_lowers_ascii_letters_only(spark):
    rows = [(1, "UNDER THE MIT LICENSE", None, None), (2, "under the m\u0130t license \u212a \u00c9", None, None), (3, "\u00c9 UNDER the MIT License", None, None)]
    got = {r.doc_id: (r.base_labels, r.n_words) for r in license_scan.scan_licenses(docs(spark, rows)).collect()}
    assert got == {1: ("mit", 4), 2: ("", 6), 3: ("mit", 5)}


def test_license_sql_equals_the_operator(spark, tmp_path):
    import duckdb

    wrapped = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files to deal\nin the Software without restriction"
    rows = [(1, wrapped, None, None), (2, "a\n" * 90 + wrapped + "\nb" * 90, None, None), (3, None, None, None), (4, "UNDER the MIT license \u0130", None, None), (5, "all\nrights\n" + "x " * 200 + "reserved", None, None)]
    path = str(tmp_path / "documents.parquet")
    docs(spark, rows).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{path}/*.parquet')")
    cursor = con.execute(license_scan.oracle())
    expected = {tuple(r) for r in cursor.fetchall()}
    got = license_scan.scan_licenses(docs(spark, rows)).select(*[c[0] for c in cursor.description])
    assert {tuple(r) for r in got.collect()} == expected and ("mit" in {r[5] or r[6] for r in expected})


def test_license_empty(spark):
    assert license_scan.scan_licenses(docs(spark, [])).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score double")


def test_search_edges(spark):
    rng = np.random.default_rng(2)
    own = rng.normal(size=(300, 8)).astype(np.float32)
    rows = [(i, own[i].tolist(), 1, 0.0) for i in range(300)]
    rows += [(1000 + i, own[40].tolist(), 1, 0.0) for i in range(100)]  # copies
    rows += [(2000, None, 1, 0.0), (2020, [0.0] * 8, 1, 0.0), (2040, [float("nan")] + [1.0] * 7, 1, 0.0), (2060, [1.0, None] + [1.0] * 6, 1, 0.0), (2080, [1.0], 1, 0.0), (None, own[0].tolist(), 1, 0.0)]
    got: dict = {}
    for r in ann.search(vectors(spark, rows), block_rows=128).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ids = np.array([*range(300), *range(1000, 1100)])
    every = np.concatenate([own, np.repeat(own[40:41], 100, 0)]).astype(np.float64)
    hit = 0
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    for q, found in got.items():
        score = (every * every[np.flatnonzero(ids == q)[0]]).sum(1)
        order = [(ids[i], score[i]) for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        assert len(found) == 20 and all(abs(s - score[np.flatnonzero(ids == v)[0]]) < 1e-12 for v, s in found)
        hit += len({v for v, _ in order} & {v for v, _ in found})
    assert hit >= 0.95 * 20 * len(got)
    copies = [v for v, _ in got[40] if v >= 1000]
    assert len(copies) > 10 and copies == list(range(1000, 1000 + len(copies)))  # ties go to the smaller ids


def nearest(rows, k=20):
    """All pairs: the k nearest distinct ids of each query."""
    out = {}
    for q in sorted({i for i, _ in rows if i % 20 == 0}):
        best: dict = {}
        for own in (np.array(v, np.float32).astype(np.float64) for i, v in rows if i == q):
            for i, v in rows:
                if i != q:
                    best[i] = max(best.get(i, -np.inf), float((np.array(v, np.float32).astype(np.float64) * own).sum()))
        out[q] = sorted(best, key=lambda i: (-round(best[i], 9), i))[:k]
    return out


def found_ids(rows):
    got: dict = {}
    for r in rows.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    return got


def test_search_with_repeated_rows(spark):
    rng = np.random.default_rng(5)
    own = rng.normal(size=(60, 8)).astype(np.float32).tolist()
    every = [(i, own[i]) for i in range(60)] * 2  # each row twice
    copies = every + [(100, own[0])] * 25 + [(i, own[0]) for i in range(101, 130)]  # a class whose smallest id repeats
    several = [(i, (np.array(own[i % 60]) * f).tolist()) for i in range(40) for f in (1, 1.01, 1.02)]  # an id with several vectors
    for rows in (every, copies, several):
        got = found_ids(ann.search(vectors(spark, [(i, v, 1, 0.0) for i, v in rows]).coalesce(1)))
        assert got == nearest(rows)


def test_search_shortlist_counts_ids(spark):
    rng = np.random.default_rng(6)
    near = np.array([1.0] + [0.0] * 7)
    rows = [(20, near.tolist())] + [(1, (near * 3 + rng.normal(0, 0.01, 8)).tolist()) for _ in range(200)]  # one id crowds the best rows
    rows += [(i, rng.normal(0, 0.3, 8).tolist()) for i in range(2, 20)] + [(i, rng.normal(0, 0.3, 8).tolist()) for i in range(21, 30)]
    got = found_ids(ann.search(vectors(spark, [(i, v, 1, 0.0) for i, v in rows]).coalesce(1)))
    assert len(got[20]) == 20 and len(set(got[20])) == 20 and got[20][0] == 1


def made_vectors(kind, n):
    rng = np.random.default_rng(7)
    if kind == "clustered":
        centres = rng.normal(size=(n // 50, 64))
        return (centres[rng.integers(0, len(centres), n)] + rng.normal(0, 0.7, (n, 64))).astype(np.float32)
    return (rng.normal(size=(n, 64)) * rng.lognormal(0, 0.3, (n, 1))).astype(np.float32)  # all directions, uneven lengths


@pytest.mark.parametrize("kind, n", [("clustered", 20_000), ("even", 20_000), ("clustered", 200_000), ("even", 200_000)])
def test_search_recall_and_session(spark, tmp_path, kind, n):
    """Against brute force, at sizes ten times apart, in many blocks and cells; nothing of the session changes."""
    every, own = n // 100, made_vectors(kind, n)
    lists = pa.FixedSizeListArray.from_arrays(pa.array(own.reshape(-1)), 64).cast(pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": lists}), f"{tmp_path}/v.parquet", row_group_size=10_000)
    before = {r.key: r.value for r in spark.sql("SET").collect()}
    got = ann.search(spark.read.parquet(f"{tmp_path}/v.parquet"), every=every).collect()
    assert {r.key: r.value for r in spark.sql("SET").collect()} == before
    own = own.astype(np.float64)
    hits = []
    for q in range(0, n, every):
        score = own @ own[q]
        score[q] = -np.inf
        best = set(np.lexsort((np.arange(n), -score))[:20].tolist())
        found = {r.vec_id: r.score for r in got if r.query_id == q}
        assert len(found) == 20 and all(abs(score[v] - s) < 1e-9 for v, s in found.items())
        hits.append(len(best & set(found)) / 20)
    assert np.mean(hits) >= 0.95 and min(hits) >= 0.6


def test_search_of_a_hot_direction(spark):
    """A third of the rows in one cell, of which one block is too small: dealt out, and nothing is lost."""
    rng = np.random.default_rng(11)
    hot = np.eye(16)[0] * 5 + rng.normal(0, 0.01, (700, 16))
    own = np.concatenate([hot, rng.normal(size=(1_300, 16))]).astype(np.float32)
    got = found_ids(ann.search(vectors(spark, [(i, v.tolist(), 1, 0.0) for i, v in enumerate(own)]), block_rows=100))
    expected = {}
    every = own.astype(np.float64)
    for q in range(0, 2_000, 20):
        score = every @ every[q]
        expected[q] = [i for i in np.lexsort((np.arange(2_000), -score)).tolist() if i != q][:20]
    assert np.mean([len(set(got[q]) & set(expected[q])) / 20 for q in expected]) >= 0.95


def odd_vectors(kind, n=2_000, dim=32):
    rng = np.random.default_rng(12)
    own = rng.normal(size=(n, dim))
    if kind == "tight":  # groups that differ by less than codes tell
        return rng.normal(size=(4, dim))[rng.integers(0, 4, n)] + own * 1e-3
    if kind == "one tight group":
        own[: n // 3] = own[0] + own[: n // 3] * 1e-4
        return rng.permutation(own)
    if kind == "other queries":  # few, of one direction, and unlike all other rows
        own[::20] = 3 + own[::20] * 0.05
        return own
    if kind == "uneven lengths":
        return own * rng.lognormal(0, 4, (n, 1))
    return own * {"tiny": 1e-30, "huge": 1e25}[kind]


@pytest.mark.parametrize("kind", ["tight", "one tight group", "other queries", "uneven lengths", "tiny", "huge"])
def test_search_is_exact_on_odd_rows(spark, kind):
    own = odd_vectors(kind).astype(np.float32)
    got = found_ids(ann.search(vectors(spark, [(i, v.tolist(), 1, 0.0) for i, v in enumerate(own)]), block_rows=600))
    every = own.astype(np.float64)
    for q in range(0, len(own), 20):
        score = (every * every[q]).sum(1)
        assert got[q] == [i for i in np.lexsort((np.arange(len(own)), -score)).tolist() if i != q][:20]


def test_no_score_is_further_from_its_scan_than_bound():
    for kind in ["tight", "other queries", "uneven lengths"]:
        own = odd_vectors(kind)
        quantiser = ann.Quantiser.fit(own[:500])
        codes, off = quantiser.encoded(own)
        for query in own[:40] / np.linalg.norm(own[:40], axis=1, keepdims=True):
            table = quantiser.tables(query)
            scan = sum((table[i][codes[:, i]] for i in range(codes.shape[1])), np.zeros(len(own), np.float32))
            assert (np.abs(own @ query - scan) <= off).all()


def test_search_of_several_lengths(spark):
    rows = [(20, [1.0, 0.0], 1, 0.0), (1, [0.5, 0.5], 1, 0.0), (40, [1.0, 0.0, 0.0], 1, 0.0), (2, [2.0, 0.0, 0.0], 1, 0.0), (3, [-0.0, 1.0], 1, 0.0), (4, [], 1, 0.0)]
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(vectors(spark, rows)).collect()}
    assert got == {(20, 1, 1, 0.5), (20, 2, 3, 0.0), (40, 1, 2, 2.0)}


def test_search_empty_and_few(spark):
    assert ann.search(vectors(spark, [])).count() == 0
    few = ann.search(vectors(spark, [(20, [1.0, 0.0], 1, 0.0), (1, [0.5, 0.0], 1, 0.0), (2, [1.0, 1.0], 1, 0.0)])).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in few] == [(20, 1, 2, 1.0), (20, 2, 1, 0.5)]


def test_anisotropic_codes_keep_the_part_along_the_vector():
    rng = np.random.default_rng(3)
    own = rng.normal(size=(2000, 16))
    own /= np.linalg.norm(own, axis=1, keepdims=True)

    def along(q):
        code = q.encode_padded(own)
        back = q.centres[np.arange(q.centres.shape[0]), code].reshape(len(own), -1)
        return float(np.mean(((own - back) * own).sum(1) ** 2))

    assert along(ann.Quantiser.fit(own, threshold=0.5)) < along(ann.Quantiser.fit(own, threshold=0.0))


def test_automaton_equals_fnmatch():
    rng = np.random.default_rng(4)
    globs = ["*ab*", "a?c*", "*x", "abc", "*a*b*a*", "?", "*", "b*" + "a" * 70 + "*", "", "*" + "ab" * 40]
    texts = ["".join(rng.choice(list("abcx"), rng.integers(0, 9))) for _ in range(500)] + ["b" + "a" * 75, "ab" * 41, ""]
    machine = url_filter.Automaton([url_filter.Glob.of(g) for g in globs])
    hits = machine.match([np.frombuffer(t.encode(), np.uint8).astype(np.int64) for t in texts])
    for t, row in zip(texts, hits):
        assert row.tolist() == [fnmatch.fnmatchcase(t, g) for g in globs], t


def test_url_verdicts(spark):
    urls = [
        ("http://A.Example.NET/en/x?q", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("https://example.net/EN/", "example.net", "/EN/", "net/", "block"),
        ("http://x.net", "x.net", "", None, "allow"),
        ("http://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"),
        ("ftp://m.example.com/de/#t", "m.example.com", "/de/", "example.com/de/", "block"),
        ("http://w.org/fr/a#b", "w.org", "/fr/a", "org/fr/", "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://www.casino-win.example.org/en/", "www.casino-win.example.org", "/en/", None, "block"),
        ("http://é.org/" + "p" * 20000 + ".exe", "é.org", "/" + "p" * 20000 + ".exe", None, "block"),
        ("", "", "", None, "allow"),
    ]
    frame = spark.createDataFrame([(i, u[0], "x", "y") for i, u in enumerate(urls)] + [(None, urls[0][0], "x", "y")], "page_id long, url string, rule string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(frame).collect()}
    assert {i: u[1:] for i, u in enumerate(urls)} | {None: urls[0][1:]} == got
    assert url_filter.judge_urls(frame.limit(0)).count() == 0


def test_warc_round_trip(spark):
    same = "<p>é same</p>" * 50
    rows = [(i, f"http://h/{i} x\r\ny", same if i % 3 == 0 else f"<html>{i}</html>" * 40, "k") for i in range(1, 61)]
    rows += [(100, None, None, "k"), (101, "", "", "k"), (None, "u", same, "k"), (3, "again", same, "k"), (102, "long", "z" * 300_000, "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, first string")
    archives = warc.write_archives(pages)
    got = sorted(((r.page_id is None, r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, archives).collect()), key=repr)
    expected = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        first = 3 if html == same else 100 if not html else i
        expected.append((i is None, i, len(data), warc.sha1_base32(data), "response" if i == first else "revisit", None if i == first else first))
    assert got == sorted(expected, key=repr)
    path = archives.first().path
    assert warc.filesystem(path)[0].open_input_stream(warc.filesystem(path)[1]).read(4) == b"\x5d\x2a\x4d\x18"
    assert warc.read_archives(spark, warc.write_archives(pages.limit(0))).count() == 0


def test_warc_hot_payload(spark, monkeypatch):
    """One payload that most rows have, and many that are rare."""
    rows = [(i, f"http://x/{i}", "same" if i % 3 else f"<p>{i // 6}</p>") for i in range(300)]
    for share in (warc.HOT, 2.0):  # by broadcast, by shuffle
        monkeypatch.setattr(warc, "HOT", share)
        table = spark.createDataFrame(rows, "page_id long, url string, html string")
        got = {r.page_id: r.refers_to for r in warc.read_archives(spark, warc.write_archives(table.repartition(7))).collect()}
        first: dict = {}
        for i, _, html in rows:
            first.setdefault(html, i)
        assert got == {i: None if first[html] == i else first[html] for i, _, html in rows}


def test_warc_least_bytes(spark):
    pages = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "yyyy"), (4, "d", "yyyy")], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_archives(spark, warc.write_archives(pages, least_bytes=3)).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


MESSAGES = "conv_id long, turn long, role string, content string, calls " + chat_tools.CALL + ", result_of string, depth int"


def test_tool_links(spark):
    rows = [
        (1, 0, "assistant", None, [("a", "reply", '{"turn": 1, "text":"x","words":2,"z":1}', ["b"]), ("b", "reply", '{"words":"s","turn":1.5}', ["a"]), ("q", "zzz", "[1]", ["nope"])], None, 0),
        (1, 1, "tool", "r", None, "q", 0),
        (1, 2, "tool", "r", None, "zz", 0),
        (2, 0, "assistant", "do", [("c", "reply", '{"words": 1, "turn": 0, "text": "t"}', ["d"])], None, 0),
        (2, 1, "assistant", None, [("d", "reply", '{"text": "t", "turn": 0, "words": 1}', [])], None, 0),
        (2, 2, "tool", "late", None, "c", 0),
        (2, 3, "tool", "later", None, "c", 0),
        (2, 4, "tool", "now", None, "d", 0),
        (None, None, None, None, None, None, None),
    ]
    out = chat_tools.link_tools(spark.createDataFrame(rows, MESSAGES)).collect()
    by = {(r.conv_id, r.turn, r.part): r for r in out}
    assert len(out) == 11
    assert by[1, 0, 0].errors == "no result,cycle,unexpected z" and by[1, 0, 0].depth is None
    assert by[1, 0, 1].errors == "no result,cycle,missing text,turn is no integer,words is no integer"
    assert by[1, 0, 2].errors == "unknown dependency,arguments are no object" and by[1, 0, 2].linked_turn == 1
    assert by[1, 2, 0].errors == "no call"
    assert (by[2, 0, 0].depth, by[2, 0, 0].linked_turn, by[2, 0, 0].valid) == (1, 2, True)
    assert (by[2, 1, 0].depth, by[2, 1, 0].linked_turn, by[2, 3, 0].linked_turn) == (0, 4, 0)
    assert by[2, 0, 0].json == '{"arguments":{"text":"t","turn":0,"words":1},"call_id":"c","content":"do","name":"reply","role":"assistant"}'
    assert by[None, None, 0].json == "{}"


def test_chats_against_plain_python(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    given = {(r.conv_id, r.turn): r for r in turns.collect()}
    got = chat_tools.format_chats(turns).collect()
    assert len(got) == len(given)
    for r in got:
        own = given[r.conv_id, r.turn]
        if own.role == "user":
            answer = given.get((r.conv_id, r.turn + 1))
            answered = answer is not None and answer.role == "assistant"
            depth, t = 0, r.turn - 2
            while (r.conv_id, t) in given and given[r.conv_id, t].role == "user":
                depth, t = depth + 1, t - 2
            assert (r.depth, r.linked_turn) == (depth, r.turn + 1 if answered else None)
            expected = {"arguments": {"text": own.text, "turn": own.turn, "words": len([w for w in own.text.split() if w])}, "call_id": f"call-{r.conv_id}-{r.turn}", "name": "reply", "role": "user"}
        elif own.role == "assistant":
            assert r.linked_turn == r.turn - 1
            expected = {"content": own.text, "result_of": f"call-{r.conv_id}-{r.turn - 1}", "role": "assistant"}
        else:
            assert r.call_id is None and r.depth is None
            expected = {"content": own.text, "role": own.role}
        assert json.loads(r.json) == expected
        assert r.json == json.dumps(expected, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_tools_empty(spark):
    assert chat_tools.link_tools(spark.createDataFrame([], MESSAGES)).count() == 0


@pytest.mark.parametrize("text,expected", [('{"b":1,"a":{"d":2,"c":[1, {"z":1,"y":2}]}}', '{"a":{"c":[1,{"y":2,"z":1}],"d":2},"b":1}'), ("{", None), (None, None)])
def test_canonical_json(spark, text, expected):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(text,)], "t string").select(chat_tools.canonical(F.col("t"))).first()[0] == expected


def test_depths_equal_longest_paths(spark):
    rng = np.random.default_rng(11)
    rows, expected = [], {}
    for conv in range(4):
        after = {f"n{i}": [f"n{j}" for j in range(i) if rng.random() < (0.12, 0.0, 0.04, 0.3)[conv]] for i in range(25)}
        if conv == 1:
            after = {f"n{i}": [f"n{i - 1}"] if i else [] for i in range(60)}  # one long chain
        after |= {"x": ["y"], "y": ["x"], "z": ["x", "n0"], "w": ["nowhere"], "self": ["self"]}
        depth: dict = {"w": 0}
        while True:
            new = {k: max((depth[d] for d in v), default=-1) + 1 for k, v in after.items() if k not in depth and all(d in depth for d in v)}
            if not new:
                break
            depth |= new
        rows += [(conv, k, v) for k, v in after.items()]
        expected |= {(conv, k): d for k, d in depth.items()}
    got = chat_tools.depths(spark.createDataFrame(rows, "conv long, id string, after array<string>")).collect()
    assert {(r.conv, r.id): r.depth for r in got} == expected
