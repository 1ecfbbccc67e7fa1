"""The operators that read each text for itself: rules, licences, items, rows of ids, pieces, pages."""

from __future__ import annotations

import os
import random
import subprocess
import sys
import textwrap

import duckdb
import numpy as np
import pytest

from levelbook.llm import contamination, html, licenses, packing, pieces, quality

from .helpers import TESTDATA, clashing, docs_of

ODD = [None, "", " \n\t", "one", "a" * 3000, "x " * 2000, "é日本\U0001f600 ▁ \x00 z", "one", "  lead\n\n\ttail  "]


# Quality rules -----------------------------------------------------------------------------

def measured(text):
    words, lines = (text or "").encode().split(), [x for x in (text or "").split("\n") if x.encode().strip()]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    return dict(
        n_words=len(words), word_chars=sum(len(w.decode()) for w in words),
        n_symbols=sum((text or "").count(c) for c in "#*$%&|<>"), n_lines=len(lines),
        n_dup_lines=len(lines) - len(set(lines)), n_repeat_words=len(covered),
    )


def test_measurements(spark):
    texts = [*ODD, "a b c a b c d", "l1\nl1\n l1\nl2 #*\n\nl2 #*", "the end of the end of the end", "# $ | <b> é"]
    texts = [t for t in texts if len(t or "") < 3500]
    found = {r.doc_id: r for r in quality.ledger(docs_of(spark, texts)).collect()}
    for i, text in enumerate(texts, 1):
        for name, value in measured(text).items():
            assert found[i][name] == value, (text, name)


def test_ledger_policies_and_ablation(spark):
    good = " ".join(f"word{i}" for i in range(60)) + "."
    texts = [good, "few words", good + " idiot scum", "# " * 30 + good, good.upper(), "a b c " * 40, None]
    rows = quality.ledger(docs_of(spark, texts))
    bits = {r.doc_id: r.failures for r in rows.collect()}
    mask = quality.mask_of
    assert bits[1] == 0 and bits[2] == mask(["few_words"]) and bits[3] == mask(["abuse"])
    assert bits[4] == mask(["symbols", "repeated_words"]) or bits[4] == mask(["symbols"])
    assert bits[5] == mask(["capitals"]) and bits[7] == mask(["few_words"])
    for version, kept in (("v1", [1, 3]), ("v2", [1])):
        policy = quality.POLICIES[version]
        assert sorted(r.doc_id for r in rows.filter(quality.passes(policy)).collect()) == kept
        assert sorted(r.doc_id for r in quality.keep_documents(docs_of(spark, texts), policy).collect()) == kept
    table = {r.rule: (r.n_failed, r.n_only) for r in quality.ablation(rows, quality.POLICIES["v2"]).collect()}
    for rule in quality.POLICIES["v2"].rules:
        bit = mask([rule])
        assert table[rule] == (sum(b & bit > 0 for b in bits.values()), sum(b == bit for b in bits.values()))


# Licences ----------------------------------------------------------------------------------

def test_licences(spark):
    s = licenses.SENTENCES
    texts = [
        "Some text. " + s["mit-short"] + " More.",
        "junk\n" + s["cc-by-nc-short"],
        "Head\n\n" + s["mit-grant"].replace(" and ", "\nand ") + "\n\n" + s["mit-notice"],
        s["mit-notice"],
        s["apache-notice"] + " " + s["apache-may-not"] + "\n" + s["gpl3-short"].upper(),
        s["bsd-redistribution"] + " One. " + s["bsd-endorse"],
        None, "", "the license is not here",
    ]
    found = {r.doc_id: r.licences for r in licenses.scan(docs_of(spark, texts)).collect()}
    assert list(found.values()) == [
        ["MIT"], ["CC-BY-NC-4.0"], ["MIT"], [], ["Apache-2.0", "GPL-3.0-only"], ["BSD-3-Clause"], [], [], []
    ]
    for key, sentence in s.items():
        assert key.endswith(licenses.ID_KEY) or __import__("re").search(licenses.HINTS, sentence)


def test_every_rule_is_found_in_its_own_text(spark):
    rules = licenses.RULES
    texts = [" ".join(licenses.SENTENCES[k] for k in rule.sentences) for rule in rules]
    wrapped = [textwrap.fill(t, 60, break_on_hyphens=False) for t in texts]
    found = {r.doc_id: r.licences for r in licenses.scan(docs_of(spark, [*texts, *wrapped])).collect()}
    n = len(rules)
    for i, rule in enumerate(rules, 1):
        # A rule that a longer one of the same licence holds names the same licence.
        assert found[i] == [rule.licence], rule
        assert found[n + i] == [rule.licence], (rule, "wrapped")


def test_sentences_are_known_wrapped_at_every_word(spark):
    texts, expected = [], []
    for key, sentence in licenses.SENTENCES.items():
        words = sentence.split(" ")
        for i in range(1, len(words)):
            for gap in ("\n", " \n\t", "  ", "\u00a0"):
                before, after = " ".join(words[:i]), " ".join(words[i:])
                if gap == "\u00a0" and before[-1] in ".:;":
                    continue  # only spaces and line ends close a sentence
                texts.append(before + gap + after)
                expected.append([licenses._table()[part] for part in licenses._parts(key).values()])
    found = {r.doc_id: r.sentence_ids for r in licenses.scan(docs_of(spark, texts)).collect()}
    for i, (text, ids) in enumerate(zip(texts, expected, strict=True), 1):
        assert found[i] == ids, text


def test_sentences_on_lines_and_over_lines(spark):
    s = licenses.SENTENCES
    grant = textwrap.fill(s["mit-grant"], 60, break_on_hyphens=False)
    texts = [
        f"My project\nAll rights reserved.\n{grant}",
        f"My project\n{grant}",
        f"All rights reserved\nand a line\n{textwrap.fill(s['gpl-free'], 50)}\n{textwrap.fill(s['gpl-hope'], 40)}",
        "// SPDX-License-Identifier: MPL-2.0\n#include <stdio.h>",
        "# SPDX-License-Identifier: LGPL-2.1-only",
        "the id MIT\nMIT\nalone names no license",
        "\n".join(f"a line of {i} that a license holds" for i in range(3000)) + "\n" + grant,
    ]
    found = {r.doc_id: r.licences for r in licenses.scan(docs_of(spark, texts)).collect()}
    assert [found[i] for i in range(1, 8)] == [
        ["MIT", "Proprietary"], ["MIT"], ["GPL-3.0-or-later", "Proprietary"], ["MPL-2.0"], ["LGPL-2.1-only"], [], ["MIT"],
    ]
    assert len({rule.licence for rule in licenses.RULES}) >= 40


def test_twin_finds_every_rule(spark):
    texts = [sep.join(licenses.SENTENCES[k] for k in rule.sentences) for rule in licenses.RULES for sep in (" ", "\n", "\n\n")]
    texts += [textwrap.fill(t, 30, break_on_hyphens=False) for t in texts] + ["", None, "All rights reserved\nReleased under the\nMIT License. x"]
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts, 1)))
    twin = {r[0]: r[1:] for r in connection.execute(licenses.oracle()).fetchall()}
    found = licenses.scan(docs_of(spark, texts)).collect()
    assert {r.doc_id: (" ".join(r.sentence_ids), " ".join(r.licences), r.first_licence, r.n_sentences) for r in found} == twin


def test_licence_plan_is_native(spark):
    plan = licenses.scan(docs_of(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# Decontamination ---------------------------------------------------------------------------

def distance_brute(item, text):
    row, best = list(range(len(item) + 1)), (len(item), 0)
    for j, c in enumerate(text, 1):
        before, row = row, [0]
        for i in range(1, len(item) + 1):
            row.append(min(before[i] + 1, row[-1] + 1, before[i - 1] + (item[i - 1] != c)))
        if row[-1] < best[0]:
            best = row[-1], j
    return best


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(400):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 20)))
        assert contamination.best_match(contamination.alphabet_bits(item), len(item), text) == distance_brute(item, text)


def test_matches_are_those_within_the_budget():
    rng = random.Random(2)
    items = ["".join(rng.choice("abcd ") for _ in range(rng.randint(12, 40))).strip() or "abc" for _ in range(6)]
    items = [contamination.normal(x) for x in items]
    matcher = contamination.Matcher(list(enumerate(items)), 0.15)
    for _ in range(150):
        item = list(rng.choice(items))
        for _ in range(rng.randint(0, 7)):
            at = rng.randrange(len(item))
            item[at:at + rng.randint(0, 1)] = rng.choice(["", "a", "zz"])
        text = contamination.normal("".join(rng.choice("abcd ") for _ in range(30)) + "".join(item) + " dd")
        expected = set()
        for i, x in enumerate(items):
            distance, _ = distance_brute(x, text)
            if distance <= contamination.budget(len(x), 0.15):
                expected.add((i, distance))
        assert {(i, d) for i, d, _, _ in matcher.matches(text)} == expected


@pytest.mark.parametrize("shard", [1 << 20, 40])
def test_contamination(spark, shard):
    item = "The quick brown fox jumps over the lazy dog near the old river bank"
    items = spark.createDataFrame(
        [(7, item), (7, None), (8, ""), (9, "another item that nobody copies at all, ever"), (3, item.upper())],
        "item_id long, text string",
    )
    texts = [f"x\n{item.replace(' ', '  ')} y", item.replace("fox", "fax"), item[:30], None, "", item.lower()]
    found = contamination.contamination(docs_of(spark, [*texts, (1, texts[0])]), items, shard_bytes=shard).collect()
    assert sorted((r.doc_id, r.item_ids, r.least_distance) for r in found if r.contaminated) == [
        (1, [3, 7], 0), (1, [3, 7], 0), (2, [3, 7], 1), (6, [3, 7], 0)
    ]
    assert len(found) == 7
    kept = contamination.keep_clean(clashing(spark, texts), items, shard_bytes=shard)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]
    nothing = items.filter("item_id > 99")
    assert not any(r.contaminated for r in contamination.contamination(docs_of(spark, texts), nothing).collect())
    assert contamination.contamination(docs_of(spark, []), items).count() == 0


def test_short_items_match_whole_words(spark):
    items = spark.createDataFrame([(1, "the"), (2, "a b")], "item_id long, text string")
    texts = ["They breathe other air", "over THE hill", "the", "xa by a b", "xa by"]
    found = contamination.contamination(docs_of(spark, texts), items).collect()
    assert {r.doc_id: r.item_ids for r in found} == {1: [], 2: [1], 3: [1], 4: [2], 5: []}


def test_contamination_of_many_equal_rows_in_shards(spark):
    """Equal rows stay rows of their own, with a hit each, however many shards there are."""
    items = spark.createDataFrame([(i, f"item number {i} of the long list of items") for i in range(4)], "item_id long, text string")
    rows = [(None, "")] * 300 + [(None, "item number 2 of the long list of items")] * 30
    found = contamination.find(docs_of(spark, rows), items, shard_bytes=60, rate=0.0)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    hits = [[h.item_id for h in r.hits] for r in found.collect()]
    assert sorted(hits) == [[]] * 300 + [[2]] * 30


# Packing -----------------------------------------------------------------------------------

def test_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(100):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(0, 40))]
        rows: list[list[int]] = []
        for size in sorted(sizes, reverse=True):
            fitting = [r for r in rows if 20 - sum(r) >= size]
            (min(fitting, key=lambda r: 20 - sum(r)) if fitting else rows.append([]) or rows[-1]).append(size)
        found = packing.best_fit_decreasing(sizes, 20)
        assert sorted(i for r in found for i in r) == list(range(len(sizes)))
        assert sorted(sum(sizes[i] for i in r) for r in found) == sorted(map(sum, rows))


def test_packing_loses_nothing(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "cat", "zygote", "é", "1234"]) for _ in range(rng.choice([0, 5, 40, 300]))) for _ in range(50)]
    texts += ODD
    rows = packing.pack(docs_of(spark, texts).coalesce(1), row_length=64, block_ids=2000).collect()
    encoding = packing._encoding(packing.RANKS, packing.PATTERN)
    segments: dict = {}
    for r in rows:
        ids = packing.matrix([r], 64)[0]
        assert r.segment_ends[0] == 0 and r.segment_ends[-1] == r.n_ids <= 64 and r.position_resets == r.segment_ends[:-1]
        assert (ids[r.n_ids:] == packing.END_MARK).all()
        positions = packing.positions(r.segment_ends, 64)
        for doc, offset, a, b in zip(r.doc_ids, r.doc_offsets, r.segment_ends[:-1], r.segment_ends[1:], strict=True):
            segments.setdefault(doc, {})[offset] = ids[a:b].tolist()
            assert positions[a:b].tolist() == list(range(b - a))
    for i, text in enumerate(texts, 1):
        joined = [x for offset in sorted(segments[i]) for x in segments[i][offset]]
        assert joined == [*encoding.encode_ordinary(text or ""), packing.END_MARK]
    assert len({(r.part, r.block, r.row) for r in rows}) == len(rows)
    assert packing.pack(docs_of(spark, [])).count() == 0


# Pieces ------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def model():
    return pieces.Model.load(pieces.MODEL)


def best_score(word, model, score):
    best = {0: 0.0}
    for end in range(1, len(word) + 1):
        for begin in range(end):
            if begin in best and (word[begin:end]) in score:
                best[end] = max(best.get(end, -np.inf), best[begin] + score[word[begin:end]])
    return best.get(len(word))


def test_viterbi_finds_the_best_path(model):
    score = {}
    for length in model.lengths:
        for i, s in zip(model.ids[length].tolist(), model.scores[length].tolist(), strict=True):
            score[model.text[i].replace(b" ", pieces.SPACE)] = s
    by_id = {i: s for length in model.lengths for i, s in zip(model.ids[length].tolist(), model.scores[length].tolist(), strict=True)}
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghinorst") for _ in range(rng.randint(1, 90))) for _ in range(60)] + ["▁▁▁the", "▁anthropology"]
    for word, path in zip(words, pieces.segment([w.encode() for w in words], model), strict=True):
        assert b"".join(model.text[i] for i in path).replace(b" ", pieces.SPACE) == word.encode()
        assert sum(by_id[i] for i in path.tolist()) == pytest.approx(best_score(word.encode(), model, score), rel=1e-5)


def test_cutting_into_words_changes_nothing(model):
    for text in ("a, bcd.ef »,x! ...hello..there \n\nx|y é. ”.z", "it's (so) «là».", "##a  b--c"):
        whole = (" " + text).encode().replace(b" ", pieces.SPACE)
        ids, _ = pieces.Encoder(model).encode([text.encode()])
        assert ids.tolist() == pieces.segment([whole], model)[0].tolist()


def test_long_words_are_cut_or_walked_without_changing_the_path(model, monkeypatch):
    rng = random.Random(6)
    letters = {
        "dense": "abcdefghinorst", "base64": "ABCdefGHIjkl0123456789+/", "chinese": "的一是不了人我在有他这中大来上国日本語", "mixed": "aé日b的the",
    }
    words = ["".join(rng.choice(a) for _ in range(n)) for a in letters.values() for n in (65, 300, 900)] + ["▁" * 70 + "the", "a" * 700]
    raw = [w.encode() for w in words]
    whole = pieces.segment(raw, model)
    for window in (7, 64, 1 << 16):
        monkeypatch.setattr(pieces, "WINDOW", window)
        for word, path in zip(raw, whole, strict=True):
            assert pieces.long_path(word, model).tolist() == path.tolist()
            parts = [p for some in pieces.safe_parts(word, model) for p in some]
            assert b"".join(parts) == word
            assert np.concatenate(pieces.segment(parts, model)).tolist() == path.tolist()
    # Text without spaces falls into short parts that go through the batches.
    chinese = "".join(rng.choice(letters["chinese"]) for _ in range(5000)).encode()
    parts = [p for some in pieces.safe_parts(chinese, model) for p in some]
    assert max(map(len, parts)) <= pieces.LONG


def test_a_text_that_holds_the_mark_itself(model):
    for text in ("▁", "a ▁ b", "▁▁x▁ " * 40, "no▁spaces" * 30, " ▁"):
        ids, bounds = pieces.Encoder(model).encode([text.encode(), b"", text.encode()])
        assert pieces.decode_ids(ids, bounds, model) == [text.encode(), b"", text.encode()]


def test_memory_of_a_long_text_without_spaces(tmp_path):
    script = tmp_path / "long.py"
    script.write_text(
        "import random, resource, sys\n"
        "from levelbook.llm import pieces\n"
        "rng = random.Random(1)\n"
        "text = ''.join(rng.choices(sys.argv[1], k=int(sys.argv[2]))).encode()\n"
        "model = pieces.Model.load(pieces.MODEL)\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "ids, bounds = pieces.Encoder(model).encode([text])\n"
        "assert pieces.decode_ids(ids, bounds, model) == [text]\n"
        "print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for letters, n in (("的一是不了人我在有他这中大来上国", 700_000), ("ABCdefGHIjkl0123456789+/", 2_000_000)):
        run = [sys.executable, str(script), letters, str(n)]
        used = int(subprocess.run(run, cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, check=True).stdout)
        assert used < 250, (letters, used)  # MB, for two megabytes of text


def test_round_trip(spark):
    found = {r.doc_id: r for r in pieces.encode(docs_of(spark, ODD)).collect()}
    assert all(r.round_trip for r in found.values()) and found[1].ids == [] and found[2].n_tokens == 0
    back = {r.doc_id: r.text for r in pieces.decode(spark.createDataFrame(list(found.values()))).collect()}
    assert [back[i] for i in range(1, len(ODD) + 1)] == [t or "" for t in ODD]
    assert pieces.encode(docs_of(spark, [])).count() == 0
    assert pieces.encode(clashing(spark, ODD)).columns == ["doc_id", "ids", "n_tokens", "n_bytes", "decoded_sha256", "round_trip"]


def test_round_trip_of_the_test_documents(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    assert pieces.encode(docs).filter("NOT round_trip").count() == 0


# Pages -------------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<div class="cookie-notice"><p>We use cookies, a lot of them, really, all over the place.</p></div>
<nav><ul><li>Home<li>News</ul></nav>%s<aside><p>See also other long things to read on this site.</p></aside>
<section id="comments"><p>I like this very much and I want to say so with many words.</p></section>
<form><p>Sign up</p></form><script>var a = "</p>";</script><footer>&copy; us</footer></body></html>"""
BODY = "<h1>A  title</h1><p>First <b>long</b> paragraph of the text, it\n goes on &amp; on.<p>Be.<ul><li>One</li></ul><p>Last words of a long text here."
TEXT = "A title\n\nFirst long paragraph of the text, it goes on & on.\n\nBe.\n\nOne\n\nLast words of a long text here."


@pytest.mark.parametrize("around", ["<article>%s</article>", "<main>%s</main>", '<div id="content">%s</div>', "<article><div>%s</div></article>"])
def test_main_text(around):
    assert html.main_text(PAGE % (around % BODY)) == TEXT


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<p>", ""), ("plain", "plain"), ("<script>x</script>", ""), ("<article></article>", ""),
    ("<nav>open <ul><li>m<article><p>Body text</p>", "Body text"), ("a<br>b<p>c<b>d", "a b\n\ncd"),
    ('<article><p>x</p><div class="advert"><p>buy</p></div><p>y</p></article>', "x\n\ny"),
    ("<article><p>x</p></nav></div><p>y</p></article>", "x\n\ny"), ("<p>a&nbsp;&lt;b&gt; &#233;</p>", "a <b> é"),
])
def test_odd_pages(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize("name", [
    "overflow-hidden", "elementor-widget-text-editor", "has-sidebar", "no-sidebar", "related-to-health", "layout no-sidebar wide",
    "content-sidebar-wrap", "sidebar-right", "hidden-mobile",
])
def test_names_that_only_hold_a_word_of_noise(name):
    for page in (f'<article><h1>A</h1><div class="{name}"><p>Some text of the page, long enough.</p></div></article>',
                 f'<body class="x"><div id="{name}"><h1>A</h1><p>Some text of the page, long enough.</p></div></body>'):
        assert html.main_text(page) == "A\n\nSome text of the page, long enough."


@pytest.mark.parametrize("name", [
    "ad", "cookie-notice", "hidden", "sidebar-wrapper", "x sidebar", "siteFooter", "comment-list", "related-posts", "ad_1", "social-share-buttons",
])
def test_names_of_noise(name):
    page = f'<article><p>Some text of the page.</p><div class="{name}"><p>Other text of the page.</p></div></article>'
    assert html.main_text(page) == "Some text of the page."


def paragraphs(name, n):
    return [f"{name} {i} is a paragraph of the story that is long enough to be its content." for i in range(n)]


def marked(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


@pytest.mark.parametrize("page", [
    "<body><div><section>%s</section><section>%s</section></div></body>",
    "<body><div>%s<blockquote>%s</blockquote></div></body>",
    "<body><article>%s</article><article>%s</article></body>",
    "<body><main><article>%s</article><section>%s</section></main></body>",
    "<body><main><div>%s</div><div>%s</div></main></body>",
])
@pytest.mark.parametrize("n, m", [(18, 7), (7, 18), (12, 13)])
def test_all_parts_of_a_story_stay(page, n, m):
    if "section>%s</section></main>" in page and n > m:
        n = m  # an article with the bulk of the content is the text
    one, two = paragraphs("One", n), paragraphs("Two", m)
    assert html.main_text(page % (marked(one), marked(two))) == "\n\n".join([*one, *two])


def test_a_teaser_article_does_not_replace_the_story():
    story = paragraphs("Story", 9)
    page = f"<body><main>{marked(story)}<article><p>Teaser of another story, to be read on its own page.</p></article></main></body>"
    assert html.main_text(page).startswith("\n\n".join(story))


def test_extract(spark):
    pages = spark.createDataFrame(
        [(1, "u", PAGE % BODY, "x"), (None, None, None, "y"), (1, "u", PAGE % BODY, "x")],
        "page_id long, url string, html string, n_chars string",
    )
    rows = html.extract(pages).collect()
    assert rows[0] == rows[2] and rows[1].text == "" and rows[1].n_chars == 0 and rows[0].n_chars == len(rows[0].text)
    assert html.extract(pages.limit(0)).count() == 0


def test_pages_of_the_test_data(spark):
    import html as entities
    import re

    pages = spark.read.parquet(f"{TESTDATA}/pages.parquet")
    found = {r.page_id: r.text for r in html.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"(?s)<article>(.*?)</article>", r.html).group(1)
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", article)]
        assert found[r.page_id] == "\n\n".join(b for b in blocks if b)
