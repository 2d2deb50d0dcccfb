"""The corpus operators against plain Python on small tables of odd rows, and against SQL on the smallest test tables."""

import json
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from verify import compare, connect

from plansieve.llm import decontaminate, lattice, licenses, mainhtml, neardup, packing, quality, sharding, substrings, warc
from plansieve.llm.components import components
from plansieve.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
PROSE = "it was the best of times it was the worst of times it was the age of wisdom it was the age of foolishness"
OTHER = " ".join(f"word{k}" for k in range(80))
LONG = " ".join(f"t{k % 997} u{k % 31}" for k in range(15_000))

# Nulls, empty and blank texts, exact and near copies, repeated rows and ids, a very long text, odd characters.
ODD = [
    (1, OTHER), (2, OTHER), (3, OTHER.replace("word40 ", "")), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "One"),
    (9, "two words"), (10, PROSE), (10, PROSE), (11, PROSE.upper() + "\n" + PROSE + "\n" + PROSE), (12, LONG), (13, LONG + " tail"),
    (None, PROSE), (None, None), (14, "É é ÉCOLE école\x00x a<|endoftext|>b 中文 ½ x y"), (15, OTHER + " " + OTHER),
    (16, "### $$$ *** " * 40), (17, "The MIT License. Released under the MIT License. All Rights RESERVED; CC-BY, cc by cc by"),
    (18, "this work is licensed under the GNU General Public License, version 3."), (19, "all rights all rights reserved"),
]
CLASHES = ["words", "row", "shard", "slot", "bucket", "hits", "part", "node", "key", "cell", "label", "text_hash", "more", "probe", "copies", "a b", "c.d"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in CLASHES}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def sorted_rows(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


def got(df, *columns):
    return sorted_rows(df.select(*columns).collect())


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_against_sql(spark, con, name):
    problem, n, _ = compare(spark, con, name, SF_DIR)
    assert problem is None
    assert n > 0


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_query_reads_every_row(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    source = spark.read.parquet(f"{SF_DIR}/{'pages' if 'page_id' in df.columns else 'documents'}.parquet")
    key = df.columns[0]
    assert df.select(key).distinct().count() == source.select(key).distinct().count()


# --- sharding ------------------------------------------------------------------------------------------


def test_sharding(odd, empty):
    weights = {s: 1.0 for s in range(3)}
    rows = sharding.shard_documents(odd, weights, weights | {3: 1.0}).collect()
    assert sorted_rows((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted_rows(
        (i, len((t or "").encode()) + 1, brute.crc(t)) for i, t in ODD
    )
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard in (r.shard, 3) for r in rows)
    assert sharding.shard_documents(empty, weights, weights).count() == 0


def test_weights_share_the_keys_and_zero_gets_none(spark):
    ids = spark.range(20_000)
    counts = dict(ids.select(sharding.rendezvous(F.col("id"), {0: 1.0, 1: 3.0, 2: 0.0}).alias("s")).groupBy("s").count().collect())
    assert set(counts) == {0, 1} and 2.7 < counts[1] / counts[0] < 3.3
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("id"), {0: 0.0})


# --- decontamination -----------------------------------------------------------------------------------

ITEMS = [(1, "word5 word6 word7 word8 word9 word10 word11 word12 word13 word14 word15"), (2, "The WISDOM"), (None, "two words"), (4, None), (5, "!?"), (2, "The WISDOM"), (30, PROSE)]


@pytest.mark.parametrize("limit", [1000, 0])
def test_decontamination(spark, odd, limit):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.find_hits(odd, items, max_broadcast_windows=limit).select(
        "doc_id", "n_words", decontaminate.covered(F.col("hits")).alias("n_hit"), F.size("item_ids").alias("n_items")
    )
    assert sorted_rows(found.collect()) == sorted_rows((i, *brute.decontaminated(t, ITEMS)[:3]) for i, t in ODD)


def test_windows_are_shuffled_without_their_documents_words(spark, odd):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    plan = decontaminate.find_hits(odd, items, max_broadcast_windows=0)._jdf.queryExecution().optimizedPlan()
    todo, joins = [plan], []
    while todo:
        node = todo.pop()
        children = [node.children().apply(k) for k in range(node.children().size())]
        todo += children
        if node.nodeName() == "Join":
            joins += [[c.output().apply(k).name() for k in range(c.output().size())] for c in children]
    assert joins and all("words" not in names for names in joins)


def test_decontamination_report_and_removal(spark, odd, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted_rows(decontaminate.report(odd, items).collect()) == sorted_rows((i, *brute.decontaminated(t, ITEMS)) for i, t in ODD)
    clean = [(i, t) for i, t in ODD if not brute.decontaminated(t, ITEMS)[1]]
    kept = decontaminate.remove_documents(odd, items)
    assert kept.columns == odd.columns
    assert got(kept, "doc_id", "text") == sorted_rows(clean)
    cut = decontaminate.remove_spans(odd, items)
    assert cut.count() == len(ODD)
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[9] == "" and texts[1].split() == [w for w in OTHER.split() if not 5 <= int(w[4:]) <= 15] and texts[7] == "one"
    assert decontaminate.report(empty, items).count() == 0
    nothing = items.where("false")
    assert got(decontaminate.report(odd, nothing), "doc_id", "n_hit", "contaminated") == sorted_rows((i, 0, False) for i, _ in ODD)


# --- language model ------------------------------------------------------------------------------------


@pytest.mark.parametrize("frequent", [200_000, 3])
def test_lattice_scores(odd, frequent):
    rows = lattice.score_documents(odd, lattice.standard_pieces(), frequent).collect()
    assert sorted_rows((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows) == sorted_rows(brute.base_scores(ODD))
    want = sorted(brute.lattice_scores(ODD, lattice.standard_pieces()), key=repr)
    found = sorted(((r.doc_id, r.score) for r in rows), key=repr)
    # Of rows of one doc_id the scores are compared in order.
    assert [i for i, _ in found] == [i for i, _ in want]
    order = lambda pairs: [s for _, s in sorted(pairs, key=lambda p: (repr(p[0]), p[1]))]
    assert order(found) == pytest.approx(order(want), rel=1e-9, abs=1e-6)


def test_lattice_sums_all_segmentations():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=lattice.standard_pieces())
    counts = {k: k % 97 for k in range(32_000)}
    pieces = lattice.Pieces(lattice.standard_pieces(), counts)

    def ways(text):
        if not text:
            return 1.0
        total = 0.0
        for n in range(1, len(text) + 1):
            x = pieces.known.get(text[:n])
            if x is None and n == 1:
                x = sum(pieces.bytes[b] for b in text[0].encode())
            if x is not None:
                total += np.exp(x) * ways(text[n:])
        return total

    for word in ("the", "erthan", "écrire", "中½x", "a"):
        assert pieces.log_probability(word) == pytest.approx(np.log(ways("▁" + word)))
    assert model.get_piece_size() == 32_000
    long = pieces.log_probability("ab" * 5000)
    assert np.isfinite(long) and long < -1000


def test_lattice_on_no_rows(empty):
    assert lattice.score_documents(empty, lattice.standard_pieces()).count() == 0


# --- WARC ----------------------------------------------------------------------------------------------

PAGES = [(1, "http://a", "<p>x"), (2, None, "<p>x"), (3, "http://c\r\nd", None), (4, "u", ""), (5, "u", "é" * 100_000), (5, "u", "é" * 100_000), (None, "n", "<p>x"), (None, "m", "only")]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("revisit", F.lit(2))
    records = warc.read_archives(warc.write_archives(pages)).collect()
    stored = {}
    for i, _, h in PAGES:
        stored[h or ""] = max(stored.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in PAGES:
        payload, best = (h or "").encode(), stored[h or ""]
        first = best == -1 or i == best
        want.append((i, len(payload), warc.sha1_base32(payload), "response" if first else "revisit", None if first else best))
    assert sorted_rows((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records) == sorted_rows(want)
    assert all(r.problem is None for r in records)
    assert {bytes(r.payload).decode() for r in records if r.record_type == "response"} == {h or "" for _, _, h in PAGES}


@pytest.mark.parametrize("algorithm", ["sha1", "SHA-256", "sha512", "md5", "crc32c"])
@pytest.mark.parametrize("form", ["base32", "hex", "wrong"])
def test_warc_digests_by_their_algorithm(algorithm, form):
    import base64
    import hashlib

    def label(data):
        known = algorithm.lower().replace("-", "")
        found = hashlib.new(known if known in hashlib.algorithms_available else "sha1", data).digest()
        return f"{algorithm}:{found.hex() if form == 'hex' else base64.b32encode(found).decode() if form == 'base32' else 'x' * 32}"

    record = warc.record_bytes(1, "u", b"payload", None, False)
    block = record.partition(b"\r\n\r\n")[2][:-4]
    for held, name in ((b"payload", b"Payload"), (block, b"Block")):
        record = record.replace(b"WARC-%s-Digest: sha1:%s" % (name, warc.sha1_base32(held).encode()), b"WARC-%s-Digest: %s" % (name, label(held).encode()))
    row = warc.read_record(record)
    assert row["payload"] == b"payload"
    if algorithm == "crc32c":
        assert (row["problem"], row["unchecked"]) == (None, "block,payload")
    else:
        assert (row["problem"], row["unchecked"]) == ("block digest differs" if form == "wrong" else None, None)


def test_warc_damage_is_told(spark):
    good = [warc.gzip_member(warc.record_bytes(k, "u", b"payload %d" % k, None, False)) for k in range(3)]
    bent = warc.gzip_member(warc.record_bytes(9, "u", b"payload", None, False).replace(b"payload", b"pAyload"))
    for content, problem in ((b"".join(good)[:-5], "inside a member"), (good[0] + b"junk", "header"), (good[0] + bent, "digest")):
        rows = list(warc.read_records(content))
        assert rows[0]["problem"] is None and problem in rows[-1]["problem"]
    assert list(warc.read_records(b"")) == []
    # The reading goes on after the damage, once for each damaged stretch.
    torn = good[1][:40] + warc.MEMBER_START + b"no member" + good[1][44:]
    for middle in (bent, torn, b"junk", torn + torn, warc.gzip_member(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort")):
        rows = list(warc.read_records(good[0] + middle + good[2]))
        assert [r.get("payload") for r in rows if not r["problem"]] == [b"payload 0", b"payload 2"] and len(rows) == 3
    assert [r["payload"] for r in warc.read_records(b"".join(good))] == [b"payload 0", b"payload 1", b"payload 2"]


# --- packing -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(odd, capacity):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.standard_tokenizer())
    rows = packing.pack(odd, packing.standard_tokenizer(), capacity, keep_ids=True).collect()
    want = []
    for i, t in ODD:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        for a in range(0, len(ids), capacity):
            piece = ids[a : a + capacity]
            want.append((i, a, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids), tuple(piece)))
    assert sorted_rows((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, tuple(r.ids)) for r in rows) == sorted_rows(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        upto = 0
        for offset, length in sorted(pieces):
            assert offset == upto
            upto += length
        assert upto <= capacity


def test_packing_of_no_rows(empty):
    assert packing.pack(empty, packing.standard_tokenizer()).count() == 0


def test_fullest_finds_the_best_sum():
    from itertools import product

    for counts, room in (({5: 2, 7: 3, 11: 1}, 30), ({3: 10}, 10), ({9: 1}, 4), ({2: 1, 3: 1, 8: 2}, 17)):
        chosen = packing.fullest(counts, room)
        total = lambda m: sum(k * n for k, n in m.items())
        best = max(s for ns in product(*(range(n + 1) for n in counts.values())) if (s := total(dict(zip(counts, ns)))) <= room)
        assert total(chosen) == best and all(n <= counts[k] for k, n in chosen.items())


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(5)
    histogram = {int(k): int(n) for k, n in zip(*np.unique(rng.integers(1, 2048, 20_000), return_counts=True))}
    patterns = packing.minimum_bin_slack(histogram)
    used = {}
    for p in patterns:
        for k, n in p.lengths.items():
            used[k] = used.get(k, 0) + n * p.times
    assert used == histogram
    n_tokens = sum(k * n for k, n in histogram.items())
    assert sum(p.times for p in patterns) <= 1.005 * n_tokens / 2048 + 1


# --- quality -------------------------------------------------------------------------------------------


def test_quality(odd, empty):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert got(quality.report(odd), *columns) == sorted_rows((i, *brute.quality(t)) for i, t in ODD)
    kept = quality.apply_policy(odd)
    assert kept.columns == odd.columns
    assert got(kept, "doc_id") == got(quality.report(odd).where("kept"), "doc_id")
    assert quality.report(empty).count() == 0


def test_ablations_count_what_a_rule_alone_rejects(odd):
    policy = quality.CURRENT
    entries = quality.ledger(odd).select("failed").collect()
    bits = {r.name: 1 << r.bit for r in quality.standard_rules()}
    mask = policy.mask(quality.standard_rules())
    rows = {r.rule: (r.n_failed, r.n_only) for r in quality.ablations(quality.ledger(odd), [policy]).collect()}
    for name in policy.rules:
        want = (sum(bool(e.failed & bits[name]) for e in entries), sum(e.failed & mask == bits[name] for e in entries))
        assert rows[name] == want


# --- substrings ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("cell_bits", [28, 21])
def test_substrings(odd, monkeypatch, cell_bits):
    monkeypatch.setattr(substrings, "CELL_BITS", cell_bits)
    assert sorted_rows(substrings.report(odd).collect()) == sorted_rows(brute.without_repeats(ODD))


def test_substrings_removed_from_texts(odd, empty):
    left = substrings.remove_repeats(odd)
    assert left.columns == odd.columns
    texts = {}
    for r in left.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    assert texts[1] == [OTHER] and 2 not in texts and texts[13] == ["tail"] and texts[4] == [None] and len(texts[10]) == 2
    assert substrings.report(empty).count() == 0 and substrings.remove_repeats(empty).count() == 0


def test_cut_words_keep_what_stands_between():
    assert substrings.cut_words("a\n b  c\td e", np.array([0, 0, 1, 1, 0], bool)) == "a\n b e"
    assert substrings.cut_words("  a b", np.array([1, 0], bool)) == "b"


# --- html ----------------------------------------------------------------------------------------------


def test_articles_of_the_test_pages(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    rows = {r.page_id: r for r in mainhtml.extract(pages).collect()}
    for p in pages.collect():
        assert rows[p.page_id].text == brute.article_text(p.html)
        assert rows[p.page_id].n_chars == len(rows[p.page_id].text)


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("just text &amp; more\n text", "just text & more text"),
        ("<p>" + PROSE + "<p>short<div id=comments><p>" + PROSE + "</p></div>", PROSE + "\n\nshort"),
        ("<nav><a href=x>" + PROSE + "</a></nav><main><h1>T</h1><p>a</p></main><aside>" + PROSE + "</aside>", "T\n\na"),
        ("<article><p>x<script>var a='</p>" + PROSE + "';</script>y<style>p{}</style></p><form>f</form></article>", "x\n\ny"),
        ("<div class='cookie-notice'>" + PROSE + "<p>" + PROSE + "</div><p>" + PROSE, PROSE),
        ("<div class=\"shadow\"><p>" + PROSE + "</p></div>", PROSE),
        ("<article><p>a<!-- <p>b -->c&nbsp;&lt;d&gt;<br>e</article>", "a c <d> e".replace("a c", "ac")),
        ("<div class='with-sidebar page'><article class='post tag-ads'><p>a</p></article><article class=comment><p>" + PROSE + "</article></div>", "a"),
        ("<article><p>unclosed <b>bold<p>next", "unclosed bold\n\nnext"),
    ],
)
def test_main_text(page, text):
    assert mainhtml.main_text(page) == text


A, B, C = (" ".join(f"{x}{k}" for k in range(80)) for x in "abc")
LINKS = "<ul>" + "<li><a href=x>some link or other</a></li>" * 4 + "</ul>"


@pytest.mark.parametrize(
    "page, texts",
    [
        (f"<div><p>{A}<p>{B}<div class=ad>buy</div><p>{C}</div>", [A, B, C]),
        (f"<div><p>{A}<aside>x</aside><form>f</form><div class=share>s</div><div class=ad>y</div><p>{B}</div>", [A, B]),
        (f"<div id=x><div class=part><p>{A}</div>{LINKS}<p>tiny</p>{LINKS}<div class=part><p>{B}</div></div>", [A, "tiny", B]),
        (f"<div><section><p>{A}</section>{LINKS}<section><p>{B}</section></div>", [A, B]),
        (f"<div class=top><p>{A}</div>{LINKS}<div class=text><p>{B}<p>{C}</div>", [B, C]),
        (f"<main><p>{A}<article><p>{B}</article><p>c</main><p>{C}", [A, B, "c"]),
        (f"<main><article><p>{A}</article><article><p>{B}</article></main>", [A, B]),
        (f"<article><p>{A}</article>{LINKS}<article class=second><p>{B}</article>", [A, B]),
        (f"<p>{A}<p>{B}<p>{C}<article><p>teaser</article>", [A, B, C, "teaser"]),
    ],
)
def test_main_text_drops_nothing_but_what_is_stripped(page, texts):
    assert mainhtml.main_text(page) == "\n\n".join(texts)


@pytest.mark.parametrize(
    "page, texts",
    [
        (f'<div class="content-with-sidebar"><p>{A}<p>{B}</div>', [A, B]),
        (f'<div class="widget main-widget"><p>{A}<p>{B}</div><div class=footer>f</div>', [A, B]),
        (f'<div><p>{A}<div class="comments"><p>{B}<p>{C}<p>{PROSE}</div></div>', [A]),
        (f'<p title="a hidden gem">{A}</p><p hidden="">{B}</p><p hidden>{C}</p>', [A]),
        (f"<p data-x='a > b' title=\"it's > that\">{A}</p><p>{B}", [A, B]),
        (f"<p title='unbalanced>{A}</p><p>{B}</p><b title='>c</b>", ["c"]),
        (f"<main><p>{A}<div class=ad>x</div><p>y</main><p>{B}", [A, "y"]),
        (f"<h1>Short</h1><p>x</p><p>{A}</p><p>z</p>", ["Short", "x", A, "z"]),
    ],
)
def test_names_attributes_and_edges(page, texts):
    assert mainhtml.main_text(page) == "\n\n".join(texts)


def test_the_distribution_finds_articles_that_no_tag_tells(spark):
    import re

    for sf_dir in (SF_DIR, "/root/testdata/sf0.01"):
        for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
            renamed = re.sub(r"<article\b[^>]*>", '<div class="story">', p.html).replace("</article>", "</div>")
            assert mainhtml.main_text(renamed) == brute.article_text(p.html) == mainhtml.main_text(p.html)


@pytest.mark.parametrize(
    "page",
    [
        "<a " * 350_000, "<a '<a' " * 130_000, "<a '<a' '" * 130_000 + "'>", "<!" * 500_000, "<div>" * 50_000 + "</b>" * 50_000, "<div>" * 50_000 + "x</div>" * 50_000,
        "<li>" + "<b>" * 50_000 + "<div>y</div>" * 50_000, "<p><b>" * 50_000, "<div class=ad>" * 20_000 + PROSE * 9, ("<div>" * 30 + f"<p>{PROSE}</p></div>") * 3000,
    ],
)
def test_hostile_pages_take_time_in_proportion_to_their_length(page):
    import time

    begun = time.process_time()
    mainhtml.main_text(page)
    assert time.process_time() - begun < 4


def test_pages_without_html(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", "<"), (2, "u", "<")], "page_id long, url string, html string").withColumn("text", F.lit("x"))
    assert got(mainhtml.extract(pages), "page_id", "url", "text", "n_chars") == sorted_rows([(1, None, "", 0), (None, "u", "", 0), (2, "u", "<", 1), (2, "u", "<", 1)])


# --- licences ------------------------------------------------------------------------------------------


def test_licences(odd, empty):
    rows = licenses.scan(odd).collect()
    assert sorted_rows((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == sorted_rows((i, *brute.base_licences(t)) for i, t in ODD)
    labels = {r.doc_id: r.labels for r in rows}
    assert labels[17] == "cc-by,mit,reserved" and labels[18] == "gpl,gpl-3.0" and labels[1] == ""
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in rows)
    assert licenses.scan(empty).count() == 0


@pytest.mark.parametrize(
    "text, label",
    [
        ("Released under MIT license.", "mit"), ("this code is released under the very permissive MIT License", "mit"), ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
        ("available under the terms of the BSD 3-Clause License", "bsd-3-clause"), ("This is made available under terms of the Eclipse Public License 2.0", "epl-2.0"),
        ("mit license plates are blue", ""), ("the terms of the agreement and the license", ""), ("free software released into the wild", ""),
    ],
)
def test_notices_with_words_put_in_or_left_out(spark, text, label):
    rows = [(k, f"word{k} under the of {k} and 2 0") for k in range(30)] + [(99, f"before it {text} after it")]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 99").first()
    assert found.labels == label


def test_licences_against_plain_python(spark):
    rng = np.random.default_rng(2)
    filler = "a the of terms and software license public under free 2 0 to any".split()
    rows = list(ODD)
    for k in range(300):
        t = licenses.TEMPLATES[int(rng.integers(len(licenses.TEMPLATES)))]
        words = [w for w in t.words if rng.random() > 0.1]
        for _ in range(int(rng.integers(0, 4))):
            words.insert(int(rng.integers(len(words) + 1)), str(rng.choice(filler)))
        before, after = ([str(w) for w in rng.choice(filler, int(rng.integers(0, 9)))] for _ in range(2))
        rows.append((1000 + k, " ".join([*before, *words, *after]).upper()))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute.licences(rows, licenses.TEMPLATES, licenses.MIN_SCORE, licenses.DRIFT)
    assert sorted_rows((r.doc_id, r.labels, r.score) for r in got) == sorted_rows(want)
    assert sum(bool(labels) for _, labels, _ in want) > 100


def test_every_template_finds_itself_in_a_text_and_needs_its_key_phrase():
    index = licenses.Index(licenses.TEMPLATES, licenses.BASE_PHRASES, 1000, {"the": 900, "of": 900, "to": 900, "and": 900})
    for t in licenses.TEMPLATES:
        words = ["x", "y", *t.words, "z"]
        places = [k for k, w in enumerate(words) if w in index.anchors()]
        assert t.label in index.scan(words, places)[2]
        broken = [w if w not in t.key else "no" for w in words]
        places = [k for k, w in enumerate(broken) if w in index.anchors()]
        assert t.label not in index.scan(broken, places)[2]


def test_a_template_is_found_by_its_key_whatever_else_is_altered():
    counts = {w: 500 for t in licenses.TEMPLATES for w in t.words}
    for t in licenses.TEMPLATES:
        others = sorted({*t.words} - {*t.key})
        for pair in ({a, b} for a in others for b in others):
            # The two altered words are the rarest: by them alone the template would not be proposed.
            index = licenses.Index(licenses.TEMPLATES, licenses.BASE_PHRASES, 1000, counts | {w: 490 for w in pair})
            words = ["x", *("no" if w in pair else w for w in t.words), "y"]
            meant = any(index._score(t, words, start) >= licenses.MIN_SCORE for start in range(len(words)))
            places = [k for k, w in enumerate(words) if w in index.anchors()]
            assert not meant or t.label in index.scan(words, places)[2]


# --- near duplicates -----------------------------------------------------------------------------------


def copies(n, n_words, n_edits, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in rng.integers(0, 10**6, n_words)]
    out = []
    for _ in range(n):
        w = list(words)
        for k in rng.integers(0, n_words, n_edits):
            w[k] = f"e{rng.integers(0, 10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("cell", [128, 8])
def test_near_groups(spark, odd, monkeypatch, cell):
    monkeypatch.setattr(neardup, "CELL", cell)
    texts = copies(40, 200, 3, 1) + copies(25, 120, 2, 2) + copies(3, 60, 1, 3) + copies(30, 100, 6, 4)
    rows = ODD + [(1000 - k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASHES})
    assert sorted_rows(neardup.group_documents(docs, neardup.QUERY_KIND).collect()) == sorted_rows(brute.near_groups(rows))


def test_texts_that_share_a_passage_are_not_all_compared_with_all(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELL", 8)
    monkeypatch.setattr(neardup, "MIN_DEPTH", 1)
    rng = np.random.default_rng(6)
    passage = " ".join(f"p{k}" for k in range(40))
    alone = [f"{passage} " + " ".join(f"u{k}" for k in rng.integers(0, 10**6, 14)) for _ in range(150)]
    rows = list(enumerate(alone + [t + " end" for t in alone[:5]] + copies(30, 100, 6, 4)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes, whole = [], neardup.compare_cells

    def counted(cells, found, kind):
        sizes.append((cells.count(), cells.groupBy("cell").count().agg(F.max("count")).first()[0]))
        return whole(cells, found, kind)

    monkeypatch.setattr(neardup, "compare_cells", counted)
    assert sorted_rows(neardup.group_documents(docs, neardup.QUERY_KIND).collect()) == sorted_rows(brute.near_groups(rows))
    # The second round: of 150 texts in one cluster few rows are compared, in cells of bounded size.
    assert len(sizes) == 2 and sizes[1][0] < 500 and sizes[1][1] <= 24


def test_rows_of_one_id_send_one_text_a_set_to_the_cells(spark, monkeypatch):
    texts = copies(6, 100, 1, 5)
    rows = [(7, texts[0])] * 30 + [(7, texts[1].upper())] * 5 + [(7, OTHER)] * 4 + [(k, t) for k, t in enumerate(texts[2:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sizes = []
    whole = neardup.compare_cells

    def counted(cells, found, kind):
        sizes.append((found.count(), found.select("node").distinct().count()))
        return whole(cells, found, kind)

    monkeypatch.setattr(neardup, "compare_cells", counted)
    assert sorted_rows(neardup.group_documents(docs, neardup.QUERY_KIND).collect()) == sorted_rows(brute.near_groups(rows))
    assert sizes and all(n == n_nodes == 6 for n, n_nodes in sizes)
    kept = neardup.keep_one_of_each(docs, neardup.QUERY_KIND)
    # Texts of one doc_id that are not linked are different documents; the near copies of the group of doc_id 0 go.
    assert got(kept, "doc_id", "text") == sorted_rows([(0, texts[2]), (7, OTHER)])


def test_no_distinct_document_of_one_id_is_lost(spark):
    a, b, c = copies(1, 100, 1, 6) + copies(1, 100, 1, 7) + copies(1, 100, 1, 8)
    near = copies(2, 100, 1, 9)
    rows = [(7, a), (7, b), (7, c), (8, a), (9, near[0]), (9, near[1]), (9, near[1]), (None, a), (None, a), (5, ""), (5, ""), (5, None), (6, " ")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, `a b` long").repartition(5)
    kept = [tuple(r) for r in neardup.keep_one_of_each(docs, neardup.QUERY_KIND).select("doc_id", "text", "a b").collect()]
    assert len({(d, t) for d, t, _ in kept}) == len(kept) - 1  # the rows without doc_id
    linked = [t for d, t, _ in kept if d == 9]
    assert len(linked) == 1 and linked[0] in near
    assert sorted_rows((d, t) for d, t, _ in kept if d != 9 and t and t != " ") == sorted_rows([(7, a), (7, b), (7, c), (None, a), (None, a)])
    assert {d for d, t, _ in kept if not (t or "").strip()} == {5, 6}
    again = [tuple(r) for r in neardup.keep_one_of_each(docs.repartition(2), neardup.QUERY_KIND).select("doc_id", "text", "a b").collect()]
    assert sorted_rows(again) == sorted_rows(kept)


def test_one_of_each_stays(odd, empty):
    kept = neardup.keep_one_of_each(odd, neardup.QUERY_KIND)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    groups = brute.near_groups(ODD)
    assert sorted(i for i in ids if i is not None) == sorted({i for i, _, _, k in groups if k and i is not None})
    assert ids.count(None) == 2
    assert neardup.group_documents(empty, neardup.QUERY_KIND).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k * 7919 % 1009, (k + 1) * 7919 % 1009) for k in range(500)] + [(5000, 5001), (5001, 5001)], "a long, b long")
    found = components(edges).collect()
    assert {r.component for r in found} == {min(k * 7919 % 1009 for k in range(501)), 5000} and len(found) == 503


# --- pipeline ------------------------------------------------------------------------------------------


def test_pipeline_against_plain_python(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    policy = {r.doc_id: r.kept for r in quality.report(docs).collect()}
    rows = [(i, t) for i, t in rows if policy[i]]
    assert all(not brute.quality(t)[-1] for _, t in rows)
    rows = [(i, t) for (i, t), g in zip(rows, brute.near_groups(rows, 5, 80)) if g[3]]
    removed = {i: (n, gone, sha) for i, n, gone, sha in brute.without_repeats(rows)}
    stages = dict(corpus_pipeline.STAGES)
    left = docs
    for name in ("quality_rules", "near_duplicates", "substring_dedup"):
        left = stages[name](spark, left, SF_DIR)
        assert left.columns == docs.columns
    left = {r.doc_id: r.text for r in left.collect()}
    assert set(left) == {i for i, (n, gone, _) in removed.items() if gone < n or not n}
    for i, text in left.items():
        assert len(brute.space_words(text)) == removed[i][0] - removed[i][1]
    clean = {i for i, t in left.items() if not brute.decontaminated(t, items)[1]}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF_DIR).collect()} == clean
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])


def test_pipeline_on_odd_rows_and_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    prose = copies(4, 120, 40, 11)
    rows = [*ODD, (7, prose[0]), (7, prose[1]), (7, prose[2]), (7, prose[2]), (900, prose[3]), (901, prose[3]), (None, prose[3])]
    for name, listed in (("odd", rows), ("empty", [])):
        docs = spark.createDataFrame([(d, t, "en", None, None if t is None else len(t)) for d, t in listed], columns)
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        left = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for stage, apply in corpus_pipeline.STAGES[:-1]:
            left = apply(spark, left, f"{tmp_path}/{name}")
            assert left.columns == docs.columns, stage
        found = {(r.doc_id, r.text) for r in left.collect()}
        packed = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert {r.doc_id for r in packed.collect()} == {d for d, _ in found}
        if name == "empty":
            assert not found
        else:
            assert {t for d, t in found if d == 7} >= set(prose[:3]) and (900, prose[3]) in found and 901 not in {d for d, _ in found}
