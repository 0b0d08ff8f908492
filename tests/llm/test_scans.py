"""Licences, secrets, benchmark overlap, token codec and page text against plain Python."""

import hashlib
import random
import re

import pytest
import tiktoken
from pyspark.sql import functions as F

from textloom.llm import bpe_codec, decontaminate, licenses, pages, secret_scan
from textloom.llm.queries import byte_bpe
from textloom.llm.words import word_hashes


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_licenses(spark):
    texts = [
        "Some prose. Released under the MIT License.", "LICENSED under the Apache License, Version 2.0.\nMore prose",
        "This work is licensed under the GNU General Public License, version 3. Or, at your option, any later version.",
        "This work is licensed under the GNU General Public License, version 3.", "Copyright (c) 2020 Somebody.\nAll rights reserved.",
        "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.", "all rights are reserved", "",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction.\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
        "Unknown line.\nThe software is provided \"as is\", without warranty of any kind.",
    ]
    got = [(r["sentence_ids"], r["licenses"]) for r in licenses.recognise(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == [
        ("MitRef", "MIT"), ("Apache2Ref", "Apache-2.0"), ("Gpl3Ref OrLater", "GPL-3.0-or-later"), ("Gpl3Ref", "GPL-3.0-only"),
        ("Copyright AllRights", "All-Rights-Reserved"), ("CcByNcRef CcByNcRef", "CC-BY-NC-4.0"), ("", ""), ("", ""), ("MitGrant MitNotice AsIs", "MIT"),
    ]


MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
BSD = """Copyright (c) 2020, Somebody
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above
   copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU {}General Public License as published by
the Free Software Foundation, either version {} of the License, or
(at your option) any later version."""


def test_whole_wrapped_licences(spark):
    wholes = {
        MIT: "MIT", APACHE: "Apache-2.0", BSD: "BSD-3-Clause,All-Rights-Reserved", BSD[: BSD.index("3. ")]: "BSD-2-Clause,All-Rights-Reserved",
        GPL.format("", 3): "GPL-3.0-or-later", GPL.format("", 2): "GPL-2.0-or-later", GPL.format("Lesser ", 3): "LGPL-3.0-or-later", GPL.format("Affero ", 3): "AGPL-3.0-or-later",
    }
    texts, want = [], []
    for whole, name in wholes.items():
        lines = whole.splitlines()
        forms = [whole, whole.replace("\n", "\r\n"), "\n".join("# " + x for x in lines), "/*\n" + "\n".join(" * " + x for x in lines) + "\n */", "\n".join("// " + x for x in lines)]
        texts += forms
        want += [name] * len(forms)
    texts.append("Read on. This project is licensed under the Apache License, Version 2.0")
    want.append("Apache-2.0")
    texts.append("unlicensed under the MIT Licenses")
    want.append("")
    assert [r["licenses"] for r in licenses.recognise(frame(spark, texts)).orderBy("doc_id").collect()] == want
    ids = [r["sentence_ids"] for r in licenses.recognise(frame(spark, [MIT, APACHE, BSD])).orderBy("doc_id").collect()]
    assert ids == ["Copyright MitGrant MitNotice AsIs", "Apache2Ref Compliance ObtainCopy AsIsBasis", "Copyright AllRights BsdGrant BsdNames"]


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(s for _, _, s in sorted(found))


def secret_texts():
    draw = random.Random(2)
    parts = ["token=", "PassWord: '", "secret", " = ", ":", "api_key=", "apikey \"", "AKIA", "ABCDEFGH01234567", "deadbeef" * 4, "0123456789abcdef" * 3, "xyz", "é\U0001f600 ", "\n", "short", "longenough1", "'", "token=token:abcdefghijk "]
    return ["".join(draw.choices(parts, k=draw.randrange(1, 14))) for _ in range(400)]


def test_secret_spans(spark):
    texts = secret_texts()
    rows = secret_scan.secrets(frame(spark, texts)).orderBy("doc_id").collect()
    for text, r in zip(texts, rows):
        want = base_spans(text)
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), text
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
        assert r["n_assign"] == want.count("assign") and r["n_access"] == want.count("access") and r["n_hex"] == want.count("hex")


def test_ledger_scans_only_what_is_new(spark):
    old, new = ["password=abcdefgh1", "nothing"], ["token=abcdefgh12", "nothing"]
    first = frame(spark, old)
    _, ledger = secret_scan.extend(first)
    assert ledger[0].count() == 2 * len(secret_scan.RULES)
    both = frame(spark, old + new + [old[0]])  # two unseen rows at most, and an old blob under a new path
    paths, grown = secret_scan.extend(both, ledger)
    assert grown[0].count() == 3 * len(secret_scan.RULES) and grown[0].distinct().count() == grown[0].count()
    assert {r["doc_id"]: r["n_assign"] for r in secret_scan.report(paths, grown[1]).collect()} == {0: 1, 1: 0, 2: 1, 3: 0, 4: 1}
    # a pair the ledger has is not scanned again: with its finding taken away none comes back
    paths, kept = secret_scan.extend(both, (ledger[0], ledger[1].limit(0)))
    assert {r["doc_id"]: r["n_assign"] for r in secret_scan.report(paths, kept[1]).collect()} == {0: 0, 1: 0, 2: 1, 3: 0, 4: 0}
    # a new version of one rule is scanned on every blob, the other rules are not
    rules = tuple(secret_scan.Rule("assign", r"nothing", version=2) if r.name == "assign" else r for r in secret_scan.RULES)
    paths, again = secret_scan.extend(first, ledger, rules)
    assert again[0].count() == ledger[0].count() + 2
    assert {r["doc_id"]: r["spans"] for r in secret_scan.report(paths, again[1], rules).collect()} == {0: "", 1: "assign:0:7"}


def overlaps_by_hand(text, item, words=13, share=0.8):
    """Longest stretch over all alignments of which the share agrees, its ends agreeing."""
    a, b = word_hashes(text), word_hashes(item)
    best = 0
    for shift in range(1 - b.size, a.size):
        pairs = [(shift + j, j) for j in range(b.size) if 0 <= shift + j < a.size]
        same = [bool(a[i] == b[j]) for i, j in pairs]
        for s in range(len(same)):
            for e in range(s + 1, len(same) + 1):
                if same[s] and same[e - 1] and sum(same[s:e]) >= share * (e - s) - 1e-9:
                    best = max(best, e - s)
    return best if best >= min(words, b.size) else 0


def test_overlaps(spark):
    draw = random.Random(12)
    vocabulary = [f"t{i}" for i in range(400)]
    items = [draw.choices(vocabulary, k=draw.randrange(8, 40)) for _ in range(12)]
    rows, planted = [], set()
    for n in range(60):
        words = draw.choices(vocabulary, k=60)
        if n % 2:
            k = draw.randrange(12)
            part = list(items[k])
            for _ in range(int(0.15 * len(part))):
                part[draw.randrange(len(part))] = "swapped"
            at = draw.randrange(60)
            words[at:at] = part
            planted.add((n, k))
        rows.append(" ".join(words).replace(" t1", ", T1"))
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_words"] for r in decontaminate.overlaps(frame(spark, rows), benchmark).collect()}
    want = {(n, k): overlaps_by_hand(rows[n], " ".join(items[k])) for n in range(60) for k in range(12)}
    want = {key: size for key, size in want.items() if size}
    assert all(want.get(key) == size for key, size in got.items())  # nothing that is no overlap, and the longest
    assert len(got) >= 0.97 * len(want) and len(set(got) & planted) >= 0.97 * len(set(want) & planted)


def test_codec_is_tiktoken(spark, docs):
    ranks, pattern = byte_bpe()
    plain = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(3)
    odd = ["".join(draw.choices(["a", "B", " ", "  ", "\n", "'s", "'", "7", "é", "\U0001f600", "<|endoftext|>", "!", "　", "\t"], k=600)) for _ in range(40)]
    texts = [r["text"] for r in docs.select("text").collect()] + odd + ["a" * 3000, " " * 3000, "ab " * 3000]
    assert all(bpe_codec.encode_text(plain, t, most) == plain.encode_ordinary(t) for t in texts for most in (7, 100))
    assert all("".join(bpe_codec.pieces(t, 7)) == t for t in texts)
    rows = bpe_codec.round_trip(frame(spark, texts), ranks, pattern, most=50).orderBy("doc_id").collect()
    for text, r in zip(texts, rows):
        ids = plain.encode_ordinary(text)
        assert r["same"] and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_page_structure():
    page = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body class="has-sidebar">
      <nav><ul><li>menu</li></ul></nav><div class="ad">buy</div><!-- <p>no</p> --><header>site</header>
      <article><header><h1>Title &amp; more</h1></header><p>One<br>two   <b>three</b></p><p>four <i>five</i>
      <div class="cookie-notice"><div>notice</div> still</div><section id="comments"><article>reader</article></section>
      <form>ask</form><p data-x="a>b">six &lt;7&gt;</article><aside>side</aside><footer>&copy;</footer>"""
    assert pages.main_text(page) == "Title & more\nOne two three\nfour five\nsix <7>"
    assert pages.main_text("<nav>menu<p>never closed<article><p>text</article>") == "text"


@pytest.mark.parametrize("page, want", [
    ('<article><p class="ad">Buy<p>Text</p><p>More</p></article>', "Text\nMore"),
    ('<article><p class="ad">Buy <b>now<div>Text</div></article>', "Text"),
    ('<article><div><p class="ad">Buy</div>Text</article>', "Text"),
    ('<article><p class="ad">Buy</div> still</p>Text</article>', "Text"),
    ('<article><ul><li class="promo">Buy<ul><li>a<li>b</ul>c<li>Text</ul>More</article>', "Text\nMore"),
    ('<article><ul><li class="promo">Buy</ul>More</article>', "More"),
    ('<article><dl><dt>One<dd class="ad">Buy<dt>Two</dl>More</article>', "One\nTwo\nMore"),
    ('<article><table><tr><td class="ad">Buy<table><tr><td>x</table>y<td>Text<tr class="ad"><td>z<td>z<tr><td>More</table>End</article>', "Text\nMore\nEnd"),
    ('<article class="has-sidebar"><p>Text</p></article>', "Text"),
    ('<article class="share related"><p>Text</p></article>', "Text"),
    ('<div class="content share-enabled"><p>Text</p></div>', "Text"),
    ('<article>Text<div class="ad-container">Buy</div><div id="comments-list"><article class="comment">me</article></div></article>', "Text"),
    ('<article>Text</article><article class="comment">me</article>', "Text"),
])
def test_left_out_elements_end_where_html_ends_them(page, want):
    assert pages.main_text(page) == want


def lcs_size(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_shared_lines_are_a_longest_subsequence():
    draw = random.Random(4)
    for _ in range(300):
        a, b = ([draw.choice("abcd") for _ in range(draw.randrange(12))] for _ in range(2))
        places = sorted(pages.shared_lines(a, b))
        rest = iter(b)
        assert len(places) == lcs_size(a, b) and all(a[i] in rest for i in places)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_differencing(spark, parts):
    rows = [(i, f"http://h{i % 2}.example/p/{i:03}", f"<div>top of {i % 2}</div><p>own {i}</p><div>end of {i % 2}</div>") for i in range(40)]
    rows.append((99, "http://alone.example/", "<div>top of 0</div>"))
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["page_id"]: r["text"] for r in pages.extract(table).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: f"own {i}" for i in range(40)} | {99: "top of 0"}
