"""Operators on one text at a time, against plain versions and the tokenizers library."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from anomalypool.llm import bpe, bpe_columns, chat_tree, html_extract, packing, quality_model, quality_rules, simhash, text_stats, token_counts

V = bpe.vocabulary_path()
SCHEMA = "doc_id long, text string"
TEXTS = ["", None, "one", " ", "a\nb", "the cat sat on the mat. " * 30, "é日😀\t\x0b x  y\r\n", "<|endoftext|> a <|endoftext|>", "z" * 5000, "ab" * 3000 + " " * 90, "Hello world's 123 $$$!!", "\x1c\x85  x"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(V)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, long, tied and repeated rows, and columns whose names clash."""
    rows = [(i, t, "x", i) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "x", 5), (None, "no id at all", "x", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, _id string, length long").repartition(3)


def test_bpe_equals_the_library(library):
    rng, own = random.Random(2), bpe.Encoder(bpe.load_merges(V), memory=50)
    ranked = bpe.Encoder(bpe.load_merges(V), bpe.ranked_chunks(bpe.load_merges(V)))
    parts = ["a", " ", "  ", "\n", "é", "日", "<|endoftext|>", "'s", "22", "the", "ing", "\t", "$$$", "😀", "x" * 700, "ab" * 900, " " * 99, "\x85", " "]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        want = library.encode(text, add_special_tokens=False).ids
        assert own.ids(text).tolist() == want == ranked.ids(text).tolist()
        decoder = bpe.Decoder(own.merges)
        assert "".join([*(decoder.feed([i]) for i in want), decoder.feed((), True)]) == library.decode(want, skip_special_tokens=False)


@given(st.lists(st.one_of(st.binary(max_size=60), st.text(alphabet="abcdehinorst .,-='/ ", max_size=60).map(str.encode)), max_size=9), st.integers(1, 9), st.integers(1, 40))
@settings(max_examples=150, deadline=None)
def test_many_transducers_equal_one_each(raws, times, read):
    m = bpe.load_merges(V)
    raws = [raw * times for raw in raws]
    assert m.merge_all(raws) == bpe.Transducers(m).whole(raws, read) == [m.merge(raw) for raw in raws]


def test_texts_are_encoded_together(monkeypatch):
    """One call for the pre-tokens of all of them, with what is in memory, what is too long for it, special tokens and parts of long texts."""
    rng, calls = random.Random(6), []
    words = ["the", "x" * 99, "<|endoftext|>", "\n\n", "", "é日", "don't", *("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60))]
    texts = ["", *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(50))]
    one, own = bpe.Encoder(bpe.load_merges(V)), bpe.Encoder(bpe.load_merges(V), memory=20)
    want = [one.ids(t).tolist() for t in texts]
    merge_all = bpe.Merges.merge_all
    monkeypatch.setattr(bpe.Merges, "merge_all", lambda self, pieces: calls.append(len(pieces)) or merge_all(self, pieces))
    for size, most in ((1 << 19, 1), (600, 51), (0, 10_000)):
        calls.clear()
        assert [np.frombuffer(b"".join(x for part in parts for x in part), dtype="<u4").tolist() for parts in own.many(texts, size)] == want
        assert len(calls) <= most


@given(st.one_of(st.binary(max_size=300), st.text(alphabet="abcdehinorst .,-='/ ", max_size=300).map(str.encode)), st.integers(1, 20), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_the_transducer_equals_the_whole(raw, read, times):
    m = bpe.load_merges(V)
    assert list(bpe.Transducer(m).whole(raw * times, read)) == m.merge(raw * times)


def test_the_transducer_emits_early_and_holds_little():
    m, rng = bpe.load_merges(V), random.Random(4)
    t, early, most = bpe.Transducer(m), 0, 0
    raw = "".join(rng.choice("etaoin shrdlu,.") for _ in range(4_000)).encode()
    for b in raw:
        early += len(t.feed(bytes([b])))
        most = max(most, len(t.waiting))
    left = t.close()
    assert early + len(left) == len(m.merge(raw)) and most <= m.lookahead + max(map(len, m.bytes_of)) < 300
    assert t.close() == [] and t.feed(b"") == []


def test_the_decoder_marks_what_is_no_text():
    m = bpe.load_merges(V)
    ids = [m.byte_id[b] for b in b"a\xff\xe6\x97b"]
    d = bpe.Decoder(m)
    assert "".join(d.feed([i]) for i in ids) + d.feed((), True) == b"a\xff\xe6\x97b".decode("utf-8", "replace")


def test_bpe_columns(spark, odd, library):
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe_columns.round_trip_digests(odd, V).collect()}
    want = set()
    for r in odd.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.add((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want
    back = bpe_columns.decode_column(bpe_columns.encode_column(odd, V), V)
    assert sorted(r["text"] for r in back.collect()) == sorted(r["text"] or "" for r in odd.collect())
    assert bpe_columns.encode_column(odd.limit(0), V).count() == 0


def test_token_counts(spark, odd, library):
    got = token_counts.section_token_counts(odd, V).toPandas()
    for r in odd.collect():
        text, rows = r["text"] or "", got[got.doc_id.isna() if r["doc_id"] is None else got.doc_id == r["doc_id"]].drop_duplicates("section").sort_values("section")
        encoded, ends, want = library.encode(text, add_special_tokens=False), [], Counter()
        lines = re.findall(r"[^\n]*\n|[^\n]+$", text) or [""]
        assert rows.n_chars.tolist() == list(map(len, lines)) and rows.start.tolist() == [sum(map(len, lines[:i])) for i in range(len(lines))]
        for line in lines:
            ends.append((ends[-1] if ends else 0) + len(line.encode()))
        at = 0
        for i in encoded.ids:
            want[next(k for k, e in enumerate(ends) if at < e)] += 1
            at += len(bpe.load_merges(V).bytes_of[i])
        assert rows.n_tokens.tolist() == [want[k] for k in range(len(lines))]


def test_tokens_that_cross():
    ends, sections = np.array([3, 7, 10]), np.array([4, 9, 10])
    assert [x.tolist() for x in token_counts.attribute(ends, sections)] == [[0, 0, 1], [False, True, True]]
    assert token_counts.attribute(ends, sections, "majority")[0].tolist() == [0, 1, 1]


@given(st.dictionaries(st.integers(1, 20), st.integers(1, 6), min_size=1, max_size=8), st.integers(20, 30))
@settings(max_examples=100, deadline=None)
def test_plans_use_every_piece_once(histogram, size):
    plan = packing.plan_bins(histogram, size)
    used = Counter()
    for combo, times in plan:
        assert sum(combo) <= size
        for k in combo:
            used[k] += times
    assert used == Counter(histogram)
    places = sorted((base + i // per, at + i % per * length, length) for length, _, n, per, base, at in packing.slots(plan) for i in range(n))
    for (s, a, n), (s2, b, _) in zip(places, places[1:]):
        assert b == (a + n if s == s2 else 0)


@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), min_size=1, max_size=5), st.integers(1, 30))
@settings(max_examples=100, deadline=None)
def test_fullest_is_fullest(counts, room):
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * i for s in sums for i in range(n + 1)}
    combo = packing.fullest(counts, room)
    assert sum(combo) == max(s for s in sums if s <= room) and not Counter(combo) - Counter(counts)


def test_packing(spark, odd, library):
    got = packing.pack(odd.filter("doc_id is not null").distinct(), V, size=64, keep_ids=True).toPandas()
    for r in odd.filter("doc_id is not null").distinct().collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        own = got[got.doc_id == r["doc_id"]].sort_values("piece")
        assert [i for x in own.ids for i in x] == ids and own.piece.tolist() == list(range(len(own))) and (own.length[1:] == 64).all()
        assert own.ids_crc32.tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in own.ids]
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all() and got.groupby("sequence_id").length.sum().max() <= 64
    assert packing.pack(odd.limit(0), V).count() == 0
    everything = packing.pack(odd, V)  # the null id and the repeated one included
    rows = everything.collect()
    ends = {d: sum(r["length"] for r in rows if r["doc_id"] == d) for d in {r["doc_id"] for r in rows}}
    assert ends[None] == len(library.encode("no id at all", add_special_tokens=False).ids) + 1 and ends[5] == 2 * (len(library.encode(TEXTS[5], add_special_tokens=False).ids) + 1)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1 + 1.1 * sum(ends.values()) / 1024


@given(st.text(alphabet="ab <|im_start|>\\[INST]/</s>\n", max_size=40))
def test_escape_is_reversible_and_leaves_no_control_string(text):
    shown = chat_tree.escape(text)
    assert chat_tree.unescape(shown) == text and not any(c in shown for c in chat_tree.CONTROL)
    assert chat_tree.read_turns(chat_tree.format_turn(text, text) * 2) == [(text, text)] * 2


def test_packs_of_equal_conversations_stay_bounded(spark):
    turns = spark.range(20_000).selectExpr("id AS conv_id", "0 AS turn", "'user' AS role", "'hi' AS text")
    packs = chat_tree.chat_packs(turns, V, pack_leaves=3000)
    assert max(len(r["leaves"]) for r in packs.select("leaves").collect()) == 3000
    got = chat_tree.conversation_digests(packs, V).collect()
    assert sorted(r["conv_id"] for r in got) == list(range(20_000)) and {(r["n_turns"], r["formatted_chars"]) for r in got} == {(1, len(chat_tree.format_turn("user", "hi")))}


def test_chat_packs(spark, library):
    rng = random.Random(1)
    turns, want = [], {}
    for c in range(120):
        own = [("system", "be [INST] good")] * (c % 2) + [(("user", "assistant")[i % 2], f"t{rng.randint(0, 2)} \\ </s>") for i in range(rng.randint(0 if c % 2 else 1, 5))]
        want[c] = own
        turns += [(c, i, r, t) for i, (r, t) in enumerate(own)]
    turns += [(None, 0, "user", "a"), (None, 0, "user", "a"), (None, None, "assistant", "b"), (902, 3, "user", "twice"), (902, 3, "user", "twice")]
    want |= {None: [("assistant", "b"), ("user", "a"), ("user", "a")], 902: [("user", "twice")] * 2}
    turns += [(900, None, None, None), (901, 1, "assistant", "x" * 3000), (901, 0, "user", "")]
    want |= {900: [("", "")], 901: [("user", ""), ("assistant", "x" * 3000)]}
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").withColumnRenamed("turn", "turn").repartition(4)
    packs = chat_tree.chat_packs(df, V, pack_tokens=150)
    got = {r["conv_id"]: r for r in chat_tree.conversation_digests(packs, V).collect()}
    assert set(got) == set(want)
    for c, own in want.items():
        said = "".join(f"{r}\n{t}\n" for r, t in own)
        loss = "".join(t for r, t in own if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c]["formatted_chars"] == sum(len(chat_tree.format_turn(*t)) for t in own)
    for p in packs.collect():
        assert len(p["nodes"]) == len({(n["parent"], tuple(p["ids"][n["start"] : n["start"] + n["length"]])) for n in p["nodes"]})  # shared turns once
        for i, n in enumerate(p["nodes"]):
            assert n["parent"] < i and n["position"] == (p["nodes"][n["parent"]]["position"] + p["nodes"][n["parent"]]["length"] if n["parent"] >= 0 else 0)
            assert sum(x["hi"] - x["lo"] for x in n["intervals"]) == n["position"] + n["length"]
            ids = p["ids"][n["start"] : n["start"] + n["length"]]
            (role, text), = chat_tree.read_turns(library.decode(ids, skip_special_tokens=False))
            head, body, tail = (library.encode(x, add_special_tokens=False).ids for x in chat_tree.turn_pieces(role, text))
            lost = p["ids"][n["loss_start"] : n["loss_end"]]
            assert ids == head + body + tail and lost == (body if role == "assistant" else [])
    assert chat_tree.chat_packs(df.limit(0), V).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body class="nav-open"><header>Site</header><nav><ul><li>Home</ul></nav>
<div class="cookie-notice"><p>We use cookies</div><ARTICLE><header><h1>A  &amp; B</h1></header><p><b>one<br>two</p><p>x &lt; y &nbsp; z<div class='ad'>Buy</div><ul><li>i<li>j</ul>
<aside>side</aside><form><input value="a>b">send</form><!-- no <p> --><blockquote>q<span hidden>h</span></blockquote></article><section id="comments"><article class="comment">hi</article></section><footer>f</footer></body></html>"""


def test_html_of_a_page_with_an_article():
    assert "\n".join(t for z, t in html_extract.page_blocks(PAGE) if z == "article") == "A & B\none two\nx < y z\ni\nj\nq"
    zones = html_extract.page_blocks("<body><main><p>crumbs</p><article><p>a</article></main><div class='main-wrap'>b<div class=sidebar>c</div></div><p>d")
    assert zones == [("main", "crumbs"), ("article", "a"), ("main", "b"), ("chrome", "c"), ("open", "d")]
    for broken in ("", "<", "<p", "a<b>c</i></b></p>", "<article><p>x", "<!-- never closed <p>", "<script>x", "<p a='b>c</p>", "&#x110000;&bogus; ok", "</article></div>x" * 500, "<div>" * 3000):
        html_extract.page_blocks(broken)


def test_html_of_pages_without_an_article(spark):
    line = "read our weekly letter and never miss any story again"
    rows = [(i, "http://h/a", f"<div>{line} <b>{i}</b></div><div>story number {i} tells of {'abc'[i]} {'xyz'[i]} things alone</div><nav>n</nav>") for i in range(3)]
    rows += [(3, "http://other/", f"<div>{line}</div>"), (4, None, None), (5, "http://h/b", PAGE), (6, "http://h/c", rows[0][2])]
    got = {r["page_id"]: r for r in html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i in range(3):
        assert got[i]["text"] == f"{i}\nstory number {i} tells of {'abc'[i]} {'xyz'[i]} things alone"
    assert got[3]["text"] == line and got[4]["text"] == "" and got[4]["n_chars"] == 0 and got[5]["text"].startswith("A & B") and got[6]["text"] == got[0]["text"]


def test_html_menus_of_short_blocks_go_and_phrases_of_prose_stay(spark):
    menu = "".join(f"<div>{x}</div>" for x in ("Home", "About us", "Contact", "News", "Sports desk", "Weather"))
    footer = "<ul>" + "".join(f"<li>{x}" for x in ("Terms", "Privacy", "Imprint", "Help", "Jobs", "Press")) + "</ul>"
    prose = [f"{a} woke in the middle of the night and {b} left town {c} times" for a, b, c in (("Ann", "Bob", "two"), ("Cid", "Dan", "six"), ("Eve", "Fay", "ten"))]
    rows = [(i, "http://h/", f"<body>{menu}<p>{p}</p>{footer}") for i, p in enumerate(prose)]
    got = html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()
    assert {r["page_id"]: r["text"] for r in got} == dict(enumerate(prose))


@pytest.mark.parametrize(("inner", "text"), [
    ('<p>to <a href="/hidden/cave">the cave</a></p>', "to the cave"), ('<p title="a hidden gem">kept</p>', "kept"), ('<p><a href="/view?id=menu">dishes</a> x</p>', "dishes x"),
    ('<section class="related-work"><p>others did</p></section>', "others did"), ('<ul class="social-history"><li>it began</ul>', "it began"),
    ('<h2 id="menu-planning">Menus</h2><div data-role="nav" class=x>y</div>', "Menus\ny"), ('<div class="post-comments"><p>hi</p></div><div hidden>h</div><p>z', "z"), ("<div class='ad'>a</div>b", "b"),
])
def test_html_attributes_are_names_with_values(inner, text):
    blocks = html_extract.page_blocks(f"<body><nav>n</nav><article>{inner}</article>")
    assert html_extract.text_without(blocks, set()) == text


def _covered_by_force(rows, depth):
    """{id: positions in the streams of tokens in strings that another page of the host, about something else, has too}."""
    seen, places = {}, {}
    for i, url, page in rows:
        blocks = html_extract.page_blocks(page or "")
        about = "\n".join(t for z, t in blocks if z.rstrip("?") == html_extract.level_of(blocks))
        first = 0
        for stream in html_extract.streams_of(blocks):
            words = stream.split(" ")
            for a in range(len(words) - depth + 1):
                key = html_extract.host_of(url or ""), tuple(words[a : a + depth])
                seen.setdefault(key, set()).add(about)
                places.setdefault(i, []).append((key, first + a))
            first += len(words)
    return {i: {at + k for key, at in places.get(i, ()) if len(seen[key]) > 1 for k in range(depth)} for i, _, _ in rows}


@pytest.mark.parametrize("block", [30, 500, 1 << 18])
def test_host_suffix_arrays_find_every_repeat(spark, block):
    rng, rows = random.Random(5), []
    phrase = lambda n: " ".join(rng.choice("a b c d e f".split()) for _ in range(n))
    shared = [phrase(rng.randint(4, 25)) for _ in range(6)]
    for i in range(150):
        parts = [rng.choice(shared) if rng.random() < 0.4 else phrase(rng.randint(1, 9)) + f" {i}" for _ in range(rng.randint(0, 6))]
        marks = [rng.choice(["div", "p", "nav", "footer", "article", "aside"]) for _ in parts]
        page = "".join(f"<{m}>{p}</{m}>" for m, p in zip(marks, parts))
        rows.append((i, f"http://{rng.choice(['big', 'big', 'big', 'small', 'tiny'])}/", rng.choice(rows)[2] if i % 9 == 8 else page))
    rows += [(150, None, None), (151, None, ""), (152, "http://big/", "<article>only</article>")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, text string, _row int").repartition(3)
    want = _covered_by_force(rows, html_extract.MIN_TOKENS)
    got = {r["page_id"]: r for r in html_extract.main_texts(df, block=block).collect()}
    assert {i: r["n_repeated"] for i, r in got.items()} == {i: len(c) for i, c in want.items()}
    assert {i: r["text"] for i, r in got.items()} == {i: html_extract.text_without(html_extract.page_blocks(p or ""), want[i]) for i, _, p in rows}
    assert sum(map(len, want.values())) > 500


def test_html_of_odd_rows(spark):
    kind = "page_id long, url string, html string"
    assert html_extract.main_texts(spark.createDataFrame([], kind)).count() == 0
    rows = [(None, "http://h/", "<p>x"), (1, "http://h/", "<p>y"), (1, "http://h/", "<p>y"), (2, None, "<p>" + "w " * 40000)]
    got = html_extract.main_texts(spark.createDataFrame(rows, kind)).collect()
    assert sorted((str(r["page_id"]), r["n_chars"]) for r in got) == [("1", 1), ("1", 1), ("2", 79999), ("None", 1)]


@given(st.text(alphabet="ab |#!\n\t", max_size=120))
@settings(max_examples=150)
def test_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    repeated = {j for i, w in enumerate(windows) if w in often for j in range(i, i + 5)}
    lines, seen, dup = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    got = dict(zip(text_stats.COUNTS, text_stats.text_counts(text.encode())))
    assert (got["n_words"], got["word_chars"], got["n_dup_lines"], got["n_repeat_words"]) == (len(words), sum(map(len, words)), dup, len(repeated))
    assert got["n_symbols"] == sum(text.count(c) for c in "#*$%&|<>")


def _corpus(spark, n=400):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8)))
    docs, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        words = [word() for _ in range(rng.randint(20, 80))]
        docs.append((i, " ".join(words) + "." if good else " ".join(w + rng.choice(["$$$", "###"]) for w in words) if i % 2 else " ".join(w.upper() + "!!" for w in words)))
        labels.append((i, int(good), 0))
    docs += [(n, None), (n + 1, ""), (n + 2, "same words all over again here " * 20), (None, "a clean text without any id in sight which has words enough.")]
    return spark.createDataFrame(docs, SCHEMA).repartition(4), spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


def test_quality_rules(spark):
    docs, labels = _corpus(spark)
    got = {r["doc_id"]: r for r in quality_rules.quality_verdicts(docs, labels).collect()}
    assert all(got[i]["kept"] == (i % 3 > 0) for i in range(400))
    assert [got[400 + i]["base_failed"] for i in range(3)] == [True] * 3 and got[None]["kept"]
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got.values())
    assert quality_rules.learn_rules(docs, labels.limit(0)) == [] and quality_rules.quality_verdicts(docs.limit(0), labels).count() == 0


def test_quality_model(spark):
    docs, labels = _corpus(spark)
    model = quality_model.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality_model.score_texts(docs, model).collect()}
    assert len(got) == 404 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.7) == (i % 3 > 0) for i in range(400)]) > 0.98
    assert quality_model.fit(docs, labels.limit(0)) is None
    assert {r["score"] for r in quality_model.score_texts(docs, None).collect()} == {0.5}


def test_normal_equations_are_sums_of_parts(spark):
    docs, labels = _corpus(spark, 100)
    a = quality_model.fit(docs, labels)
    b = quality_model.fit(docs.repartition(1), labels.repartition(3))
    assert np.allclose(a.weights, b.weights)


@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 1)), min_size=1, max_size=60))
def test_isotonic_rises(rows):
    s, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    at, value = quality_model.isotonic(s, y)
    assert (np.diff(value) >= 0).all() and (np.diff(at) >= 0).all() and 0 < value.min() and value.max() < 1


def test_fingerprint_bit_by_bit():
    import xxhash

    text = "The cat\tsat on\nTHE mat and the Cat sat on the mat ÉtÉ"
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(simhash.shingle_hashes(text.encode())) == want
    assert simhash.fingerprint(simhash.shingle_hashes(b"one two")) == xxhash.xxh64_intdigest(b"one two", 42)
    assert simhash.fingerprint(simhash.shingle_hashes(b" \n")) == 0


@pytest.mark.parametrize("module", [packing, bpe_columns])
def test_tasks_of_a_worker_share_what_they_have_encoded(module, monkeypatch):
    text, calls = "one task after another\n\nmeets the same chunks", []
    first = module._encoder(V)
    want = list(first.parts(text))
    monkeypatch.setattr(first, "encode_chunks", lambda chunks: calls.append(chunks))
    assert list(module._encoder(V).parts(text)) == want and not calls


@given(st.text(alphabet="ab \n\t\x85\x1c\u3000", max_size=12))
def test_white_space_beside_a_space_is_seen(text):
    encoder = packing._encoder(V)
    assert bool(encoder.uneven.search(text)) == bool(bpe.regex.search(r"\s | \s", text))


def test_packing_keeps_nothing_of_the_texts_it_read():
    encoder = packing._encoder(V)
    encoder.ids("one text before")
    tracemalloc.start()
    try:
        n = sum(len(encoder.ids(" ".join(f"w{i}x{k}" for i in range(500)))) for k in range(100))
        kept = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert n > 50_000 and kept < 1 << 20


@pytest.mark.parametrize("text", ["\n" * 1_000_001 + "a b c", "a  b " + " " * 1_000_001 + "é x\n"])
def test_long_runs_of_white_space(text, library):
    merges = bpe.load_merges(V)
    for encoder in (packing._encoder(V), bpe.Encoder(merges, bpe.ranked_chunks(merges))):
        assert encoder.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


@given(st.text(alphabet="ab1#é日 \n\t\x85\x1c\u3000'st", max_size=40), st.text(alphabet="b \n", max_size=9))
def test_packing_encodes_as_the_library(library, text, end):
    text += "<|endoftext|>" + end
    assert packing._encoder(V).ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
