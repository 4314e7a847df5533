"""Text operators against brute force, exact round trips and hand-made cases."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from landmosaic.llm import html_extract, mixing, near_dedup, piece_lattice, quality, quotations, suffix_dedup, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, taken string, wanted string"


def docs(spark, texts, sources=None):
    rows = [(i, t, None, sources[i] if sources else "s", len(t) if t else None, "x", "x", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# --- repeated strings -------------------------------------------------------------


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        n_spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeat_texts():
    rng = random.Random(4)
    shared = words(rng, 60)
    long_ = words(rng, 3000)
    texts = [None, "", "short", "ab" * 300, "x" * 200, "x" * 199, shared, shared, "é" * 150 + shared[:230], long_, long_[:4000] + "!" + long_[4001:]]
    for _ in range(25):
        base = list(words(rng, 120))
        at = rng.randrange(len(base))
        texts.append("".join(base[:at]) + shared[rng.randrange(60) :] + "".join(base[at:]))
    return texts


@pytest.mark.parametrize("options", [{}, {"split": 2, "batch": 500}])
def test_repeats_match_brute_force(spark, options):
    texts = repeat_texts()
    got = {r.doc_id: tuple(r)[1:5] for r in suffix_dedup.remove_repeats(docs(spark, texts), **options).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 200)


def test_repeats_with_hot_minimizers(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 0.9)
    monkeypatch.setattr(suffix_dedup, "HOT_SEEN", 2)
    monkeypatch.setattr(suffix_dedup, "SALTS", 3)
    texts = repeat_texts()
    for options in ({}, {"split": 2, "batch": 500}):
        got = {r.doc_id: tuple(r)[1:5] for r in suffix_dedup.remove_repeats(docs(spark, texts), **options).collect()}
        assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 200)


def test_repeats_of_repeated_rows_and_none(spark):
    text = words(random.Random(1), 80)
    twice = spark.createDataFrame([(7, text), (7, text), (7, "other"), (None, text[:150])], "doc_id long, text string")
    assert sorted(r.n_removed for r in suffix_dedup.remove_repeats(twice).collect()) == [0, 0, len(text), len(text)]
    assert suffix_dedup.remove_repeats(docs(spark, [])).count() == 0


def test_transform_kernel():
    rng = np.random.default_rng(3)
    base = [bytes(rng.integers(97, 100, 90, dtype=np.uint8)) for _ in range(4)]
    texts = [base[rng.integers(4)][a : a + 60] for a in rng.integers(0, 30, 40)]
    for length in (1, 7, 8, 20, 41):
        count = np.array([len(t) - length + 1 for t in texts])
        seen = Counter(t[i : i + length] for t, n in zip(texts, count, strict=True) for i in range(n))
        got = suffix_dedup.repeated_windows(texts, count, np.ones(len(texts)), length)
        assert [[seen[t[i : i + length]] > 1 for i in range(n)] for t, n in zip(texts, count, strict=True)] == [g.tolist() for g in got]


def test_minimizers_over_segments(monkeypatch, spark):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    texts = repeat_texts()
    rows = suffix_dedup.remove_repeats(docs(spark, texts).coalesce(1)).collect()
    assert [tuple(r)[1:5] for r in sorted(rows)] == brute_repeats(texts, 200)


def test_cut_documents_keeps_columns(spark):
    texts = repeat_texts()
    table = docs(spark, texts)
    got = suffix_dedup.cut_documents(table)
    assert got.schema.names == table.schema.names
    assert all((r.text is None) == (texts[r.doc_id] is None) and r.n_chars == len(r.text or "") for r in got.collect())


def test_many_repeated_rows_without_an_id(spark):
    """20,000 copies of one row of 4 KB, beside near copies whose snippets share its minimizers."""
    import time

    rng = random.Random(21)
    text = words(rng, 900)[:4000]
    near = [text[:k] + "#" + text[k + 1 :] for k in (300, 1900, 3500)]
    copies = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    table = copies.unionByName(spark.createDataFrame([(i, t) for i, t in enumerate(near)] + [(None, near[0]), (7, words(rng, 90))], "doc_id long, text string")).repartition(6)
    began = time.time()
    got = suffix_dedup.remove_repeats(table).collect()
    took = time.time() - began
    assert len(got) == 20_005 and took < 90
    kinds = {}
    for r in got:
        kinds.setdefault((r.doc_id, r.n_bytes, r.n_removed, r.n_spans), []).append(r)
    assert len(kinds.pop((None, 4000, 4000, 1))) == 20_001  # near[0] occurs twice, so all of it goes
    assert sorted(k[:1] + k[2:] for k in kinds) == [(0, 4000, 1), (1, 3999, 2), (2, 3999, 2), (7, 0, 0)]


def test_transform_of_many_snippets_takes_bounded_memory():
    import resource

    rng = np.random.default_rng(2)
    gram = bytes(rng.integers(97, 123, 20, dtype=np.uint8))
    texts = [bytes(rng.integers(97, 123, 180, dtype=np.uint8)) + gram + bytes(rng.integers(97, 123, 180, dtype=np.uint8)) for _ in range(suffix_dedup.SPLIT)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = suffix_dedup.repeated_windows(texts, np.full(len(texts), 181), np.ones(len(texts)), 200)
    assert not any(f.any() for f in found) and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 250_000


# --- near duplicates ----------------------------------------------------------------


def brute_components(texts, n, percent):
    def shingles(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()

    sets = [shingles(t) for t in texts]
    comp = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((comp[a], comp[b]))
                comp = [x if c == y else c for c in comp]
    return [(len(s), c) for s, c in zip(sets, comp, strict=True)]


def near_texts():
    rng = random.Random(9)
    texts = [None, "", " \t\n", "one", "One", "one two", "two one", "one two three"]
    for _ in range(6):
        base = words(rng, 150).split()
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = "edit"
            texts.append((" " if rng.random() < 0.5 else "\n").join(copy))
    return texts + [words(rng, 100) for _ in range(20)]


@pytest.mark.parametrize(("n", "percent", "largest"), [(3, 85, 4096), (5, 80, 4096), (3, 85, 6)])
def test_near_duplicates_match_brute_force(spark, n, percent, largest):
    texts = near_texts()
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs(spark, texts), n, percent, largest).collect()}
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == brute_components(texts, n, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_of_nothing_and_of_one_big_group(spark):
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0
    rng = random.Random(1)
    base = words(rng, 200).split()
    texts = []
    for i in range(150):
        copy = list(base)
        copy[rng.randrange(200)] = f"own{i}"
        texts.append(" ".join(copy))
    got = near_dedup.near_duplicates(docs(spark, texts)).collect()
    assert [(r.n_shingles, r.component_id) for r in sorted(got)] == brute_components(texts, 3, 85)


def test_crowded_nodes_are_compared_exactly(spark):
    rng = random.Random(21)
    base = words(rng, 150, 5000).split()
    texts = []
    for i in range(130):
        copy = list(base)
        for _ in range(rng.randrange(11)):
            copy[rng.randrange(150)] = f"own{i}"
        texts.append(" ".join(copy))
    got = near_dedup.near_duplicates(docs(spark, texts)).collect()
    assert [(r.n_shingles, r.component_id) for r in sorted(got)] == brute_components(texts, 3, 85)
    assert 1 < len({r.component_id for r in got}) < 130


def just_apart(rng, family, e):
    """One text of 302 words and its copies, the i-th with e[i] edits of three shingles each that no other shares."""
    base = [f"f{family}w{k}" for k in range(302)]
    places = rng.sample(range(2, 300, 3), sum(e))
    out = []
    for i, n in enumerate(e):
        copy = list(base)
        for _ in range(n):
            copy[places.pop()] = f"f{family}own{i}"
        out.append(" ".join(copy))
    return out


def test_small_families_about_the_threshold_lose_no_link(spark):
    rng = random.Random(5)
    texts = []
    for family in range(40):  # 8 edits between two texts are 0.852, 9 are 0.835: one link in 6 to 11 texts
        edits = [4, 4] + [5] * (4 + family % 6)
        texts += just_apart(rng, family, rng.sample(edits, len(edits)))
    for family in range(40, 60):  # two groups of five, linked by one pair
        one, other = [1, 1, 1, 1, 5], [7, 7, 7, 7, 3]
        texts += just_apart(rng, family, one + other)
    got = near_dedup.near_duplicates(docs(spark, texts)).collect()
    assert [(r.n_shingles, r.component_id) for r in sorted(got)] == brute_components(texts, 3, 85)


def test_crowds_beyond_the_memory_of_a_task_are_compared_by_blocks(spark):
    rng = random.Random(31)
    texts = just_apart(rng, 0, [rng.choice([0, 1, 2, 3]) for _ in range(70)]) + just_apart(rng, 1, [4, 4, 5, 5, 5, 5, 5, 5, 5, 5, 5])
    got = near_dedup.near_duplicates(docs(spark, texts), crowd_bytes=20_000).collect()
    assert [(r.n_shingles, r.component_id) for r in sorted(got)] == brute_components(texts, 3, 85)


def test_exact_links_of_blocks(monkeypatch):
    monkeypatch.setattr(near_dedup, "ROWS", 16)  # several stripes
    monkeypatch.setattr(near_dedup, "COLUMNS", 7)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) < 0.96], rng.integers(0, 2**63, 3, dtype=np.uint64)])) for _ in range(60)]
    side = rng.integers(0, 2, 60)

    def groups(pairs):
        comp = list(range(60))
        for a, b in pairs:
            x, y = sorted((comp[a], comp[b]))
            comp = [x if c == y else c for c in comp] if x != y else comp
        return comp

    common = np.array([[len(np.intersect1d(x, y, True)) for y in sets] for x in sets])
    sizes = np.array([len(x) for x in sets])
    linked = 100 * common >= 85 * (sizes[:, None] + sizes - common)
    for sides in (np.full(60, -1), side):
        want = [(i, j) for i in range(60) for j in range(i) if linked[i, j] and (sides[i] < 0 or sides[i] != sides[j])]
        got = near_dedup.exact_links(np.arange(60), sets, sides, 85)
        assert groups(want) == groups(zip(*(x.tolist() for x in got), strict=True))


def test_near_duplicates_of_rows_without_ids_and_repeated_rows(spark):
    rng = random.Random(8)
    one, other = words(rng, 80), words(rng, 80)
    rows = [(None, one), (None, one + " tail"), (5, other), (5, other), (7, other + " tail"), (7, one), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text as name", "text as n", "text as owner", "text as keys")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_dedup.near_duplicates(table).collect())
    assert got == [(False, 5, 78, 5, True), (False, 5, 78, 5, True), (False, 7, 78, 7, True), (False, 7, 79, 5, False), (True, 0, 0, 0, True), (True, 0, 78, 7, True), (True, 0, 79, 7, True)]


# --- counting and encoding ------------------------------------------------------------


def long_texts():
    rng = random.Random(2)
    return [None, "", " ", "Hello, World! it's 3 o'clock", "a<|endoftext|>b <|startoftext|>", "É́" * 300, "naïve\x1cx y z", "🙂" * 50, "x" * 3000, words(rng, 2000), "日本 語" * 200, "line\r\nline\x85end"]


def test_token_counts_match_the_library(spark, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = token_counts.load_tokenizer(path)
    texts = long_texts()
    got = {r.doc_id: r for r in token_counts.count_tokens(docs(spark, texts), path, 100).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 100)
        for chunk, overlap in ((64, 4), (500, 16)):
            assert token_counts.count_huge(library, t or "", chunk, overlap) == n
    assert token_counts.count_tokens(docs(spark, []), path).count() == 0


def test_long_texts_without_white_space_are_counted_in_proportion():
    import time

    library = token_counts.load_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(3)
    text = "".join(chr(rng.randrange(0x3041, 0x30FF)) for _ in range(400_000))
    began = time.time()
    assert token_counts.count_huge(library, text) == len(library.encode(text, add_special_tokens=False).ids)
    assert time.time() - began < 15
    for piece in ("日本語。" * 700, "a1" * 900 + " b", "x" * 700 + " " + "y" * 900 + "\n" + "z" * 300):
        for chunk, overlap in ((64, 4), (100, 50)):
            assert token_counts.count_huge(library, piece, chunk, overlap) == len(library.encode(piece, add_special_tokens=False).ids)


def test_counts_of_repeated_rows(spark):
    table = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string").selectExpr("*", "text as n_tokens", "text as n_bytes")
    got = token_counts.count_tokens(table, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 1), (1, 2), (1, 2)]


def test_word_cache_is_bounded():
    counter = token_counts.WordCounter(token_counts.load_tokenizer(public_tokenizers.path("word_bpe_49k.json")), limit=3)
    assert counter.count([b"a b c d", b"a b"]) == [4, 2] and counter.count([b"e"]) == [1] and len(counter.known) <= 4


@pytest.fixture(scope="module")
def pieces():
    return piece_lattice.Pieces(public_tokenizers.path("piece_bpe_32k.model"))


def every_path(pieces, text):
    ends = pieces.edges(text)
    scores = [[0]] + [[] for _ in text]
    for j in range(1, len(ends)):
        scores[j] = [a + s for _, i, s, _ in ends[j] for a in scores[i]]
    return sorted(scores[-1], reverse=True)


def test_n_best_matches_all_paths(pieces):
    for text in ["▁hello", "▁▁▁tion", "▁é́x", "▁the", "a\tb", "▁antthe"]:
        found = pieces.n_best(text, 6)
        assert [s for s, _ in found] == every_path(pieces, text)[:6]
        assert all(pieces.decode(ids).endswith(text[1:].replace("▁", " ")) for _, ids in found) and len({ids for _, ids in found}) == len(found)


def laid_out(texts):
    """Texts of marks as ``encode`` takes them: end to end, marks as spaces."""
    raw = [x.replace("▁", " ").encode() for x in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


@pytest.mark.parametrize("n", [1, 2, 5])
def test_parts_in_step_match_the_search_by_agenda(pieces, n):
    rng = random.Random(17)
    texts = ["".join(rng.choice("▁▁theinganorst,.\n\té日🙂") for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    size = np.array(list(map(len, texts)))
    code = np.frombuffer("".join(texts).replace("▁", " ").encode("utf-32-le"), np.int32)
    score, ways = pieces.n_best_of(pieces.lattice(code, np.cumsum(size) - size, size), n)
    ends = [np.append(0, np.cumsum(count)) for _, count in ways]
    for k, text in enumerate(texts):
        got = [(int(score[r, k]), tuple(ways[r][0][ends[r][k] : ends[r][k + 1]].tolist())) for r in range(n) if score[r, k] > -piece_lattice.ALONE]
        want = pieces.n_best(text, n)
        assert [s for s, _ in got] == [s for s, _ in want] and got[0] == want[0] and len(set(got)) == len(got)


def test_long_texts_are_encoded_by_stretches(pieces):
    rng = random.Random(29)
    for alphabet in ("  theinganorst,.\né日🙂", "日本語の", "x"):
        text = "".join(rng.choice(alphabet) for _ in range(3000))
        data, offsets = laid_out(["▁" + text])
        whole = pieces.encode(data, offsets, 3)[0]
        cut = pieces.encode_long(data, 3, 200)
        assert [s for s, _ in cut] == [s for s, _ in whole] == [s for s, _ in pieces.segmentations(text, 3)]
        assert all(pieces.decode(ids) == text for _, ids in cut)


def test_whole_texts_split_without_loss(pieces):
    text = "the cat,sat\nil"
    whole = "▁" + text.replace(" ", "▁")
    assert [s for s, _ in pieces.segmentations(text, 4)] == every_path(pieces, whole)[:4]


def test_encode_decode_round_trip(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = long_texts()
    encoded = piece_lattice.encode_documents(docs(spark, texts), path).cache()
    rows = {r.doc_id: r for r in encoded.collect()}
    back = {r.doc_id: r.text for r in piece_lattice.decode_documents(encoded, path).collect()}
    for i, t in enumerate(texts):
        assert back[i] == (t or "") and rows[i].round_trip and rows[i].n_pieces == len(rows[i].ids)
        assert rows[i].second_score is None or rows[i].second_score <= rows[i].score
    assert rows[0].ids == [] and rows[1].ids == []


@pytest.mark.parametrize("n", [1, 2, 5])
def test_encoded_documents_hold_their_n_best(spark, pieces, n):
    rng = random.Random(23)
    texts = [*long_texts(), "the cat,sat\nil", "the the the the", "a", *["".join(rng.choice("  theinganorst,.\n\té日🙂") for _ in range(rng.randrange(1, 60))) for _ in range(60)]]
    got = {r.doc_id: r for r in piece_lattice.encode_documents(docs(spark, texts), public_tokenizers.path("piece_bpe_32k.model"), n).collect()}
    for i, t in enumerate(texts):
        best = got[i].best
        assert [w.score for w in best] == [s for s, _ in pieces.segmentations(t or "", n)]
        assert len({tuple(w.ids) for w in best}) == len(best) and all(pieces.decode(w.ids) == (t or "") for w in best)
        assert (best[0].score, best[0].ids) == (got[i].score, got[i].ids) and got[i].second_score == (best[1].score if len(best) > 1 else None)
        for w in best:  # the score is that of these very pieces
            worth = {p: s for p, s in pieces.scores.values()}
            assert w.score == sum(worth.get(x, pieces.byte_score) for x in w.ids)


def test_encoding_of_repeated_rows_and_none(spark, pieces):
    path = public_tokenizers.path("piece_bpe_32k.model")
    table = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "d")], "doc_id long, text string").selectExpr("*", "text as ids", "text as score", "text as best")
    got = sorted((r.doc_id or 0, r.score, tuple(r.ids)) for r in piece_lattice.encode_documents(table, path).collect())
    assert got == sorted((i, *pieces.segmentations(t, 1)[0]) for i, t in [(1, "a b"), (1, "a b"), (1, "c"), (0, "d")])
    none = piece_lattice.encode_documents(docs(spark, []), path)
    assert none.count() == 0 and piece_lattice.decode_documents(none, path).count() == 0


# --- pages -------------------------------------------------------------------------------


LONG = "This is the story of a river that runs to the sea and of the people who live on it, for it was long and wide. "


RUSSIAN = "Река течёт к морю мимо старых деревень. Люди живут здесь с давних времён и помнят её широкой и полной рыбы."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>just  some\n text", "just some text"),
        (f"<nav><a href=a>Home</a></nav><article><h1>River</h1><p>{LONG}<p>Short one.<br>Next line.</article><footer>&copy; me</footer>", f"River\n{LONG.strip()}\nShort one. Next line."),
        (f"<body><div class='menu'><a href=x>A</a><a href=y>B</a></div><div><p>{LONG}</p><p>Tail &amp; end &#233;</p></div><div id=comments><p>{LONG}</p></div></body>", f"{LONG.strip()}\nTail & end é"),
        (f"<main><p>{LONG}</p><aside>{LONG}</aside><form><p>{LONG}</p></form><script>if (a < b) '</p>'</script><style>p{{}}</style><p>{LONG}</p></main>", f"{LONG.strip()}\n{LONG.strip()}"),
        (f"<article><p>{LONG}</p><div class='ad-box'>buy</div><!-- <p>no</p> --><ul><li>one</li><li>two</li></ul></article><div class=cookie-notice>{LONG}</div>", f"{LONG.strip()}\none\ntwo"),
        ("<article><p>a < b and <b>bold</b></p></article>", "a < b and bold"),
        (f"<div><ul><li><a href=1>{LONG}</a></li></ul><p>{LONG}</p></div>", LONG.strip()),
        (f"<form id=aspnetForm><div><h2>River</h2><p>{LONG}</p><p>{LONG}</p><aside>{LONG}</aside></div></form>", f"River\n{LONG.strip()}\n{LONG.strip()}"),
        *[(f"<body><div {name}><h1>River</h1><p>{LONG}</p></div></body>", f"River\n{LONG.strip()}") for name in ("class='layout no-sidebar'", "class='post has-comments'", "class=ad-free", "id=notice-of-meeting", "class=sidebar")],
        (f"<article><p>{LONG}</p></article><div class='comment-list'><h1>Replies</h1><p>{LONG}</p><p>{LONG}</p></div>", LONG.strip()),
        (f"<div><p>{RUSSIAN}</p><p>{RUSSIAN}</p><p>{LONG}</p></div>", f"{RUSSIAN}\n{RUSSIAN}\n{LONG.strip()}"),
        (f"<div><a href=1>{RUSSIAN}</a></div><div><h2>Река</h2><p>{RUSSIAN}</p></div><div id=comments>{RUSSIAN}</div>", f"Река\n{RUSSIAN}"),
        (f"<div><p>{LONG}</p>x<span class=ad>buy</span>y</div>", f"{LONG.strip()}\nx\ny"),
    ],
)
def test_pages(html, text):
    assert (html_extract.main_text(html) if html else "") == text


def test_second_pass_inherits_from_neighbours():
    g, b, s = "good", "bad", "short"
    assert html_extract.second_pass([g, s, s, b], [0] * 4, [9, 5, 5, 9]) == [True, True, False, False]
    assert html_extract.second_pass([b, s, g], [0] * 3, [9, 5, 9]) == [False, True, True]
    assert html_extract.second_pass([b, s, b], [0] * 3, [1, 1, 1]) == [False, False, False]
    assert html_extract.second_pass([b, s], [0, 1], [1, 1]) == [False, True]


def test_second_pass_matches_looking_around():
    """Against a search outwards from every block."""
    rng = random.Random(13)
    for _ in range(60):
        n = rng.randrange(1, 30)
        labels, inside, sizes = [rng.choice(["good", "bad", "short", "near"]) for _ in range(n)], [rng.randrange(2) for _ in range(n)], [rng.randrange(1, 60) for _ in range(n)]
        want = []
        for i in range(n):
            if labels[i] in ("good", "bad"):
                want.append(labels[i] == "good")
                continue
            sides = [[j for j in order if inside[j] == inside[i] and labels[j] in ("good", "bad")][:1] for order in (range(i - 1, -1, -1), range(i + 1, n))]
            near = [(sum(sizes[min(i, j) + 1 : max(i, j)]), labels[j] != "good") for side in sides for j in side]
            want.append(not min(near)[1] if near else True)
        assert html_extract.second_pass(labels, inside, sizes) == want


def test_density_rules_decide(monkeypatch):
    menu = "".join(f"<li><a href=/{i}>the page of that name {i}</a></li>" for i in range(5))
    html = f"<body><div>Short ad.</div><div><ul>{menu}</ul></div><p>{LONG}</p><p>Tail.</p><p>{'xyzzy plugh ' * 20}</p></body>"
    assert html_extract.main_text(html) == f"{LONG.strip()}\nTail."
    monkeypatch.setattr(html_extract, "LINK_DENSITY", 2.0)
    assert "the page of that name" in html_extract.main_text(html)
    monkeypatch.undo()
    monkeypatch.setattr(html_extract, "STOP_DENSITY", 0.0)
    assert "xyzzy" in html_extract.main_text(html)


def test_supplied_pages_give_their_articles():
    """Every block of the article element, by the library's own parser, and nothing else."""
    from html.parser import HTMLParser

    import pyarrow.parquet as pq

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.lines = False, [""]

        def handle_starttag(self, tag, attributes):
            self.inside |= tag == "article"
            if tag in ("h1", "p", "article"):
                self.lines.append("")
            elif tag == "br":
                self.lines[-1] += " "

        def handle_endtag(self, tag):
            if tag in ("h1", "p", "article"):
                self.lines.append("")
            self.inside &= tag != "article"

        def handle_data(self, data):
            if self.inside:
                self.lines[-1] += data

    for html in pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist():
        parser = Article()
        parser.feed(html or "")
        assert html_extract.main_text(html or "") == "\n".join(" ".join(x.split()) for x in parser.lines if x.strip())


def test_neighbours_decide_without_an_article_element():
    """Blocks too short to tell follow what stands around them; names switched off change nothing there."""
    menu = "".join(f"<li><a href=/{i}>{w}</a></li>" for i, w in enumerate(["Home", "News", "Travel and weather", "Sport"]))
    html = f"<body><div>Menu</div><ul>{menu}</ul><div>Sign in</div><ul>{menu}</ul><h2>River</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p><p>End.</p><div>More</div><ul>{menu}</ul><div>All rights</div></body>"
    found, _, _ = html_extract.blocks(html)
    labels = html_extract.labelled(found)
    keep = html_extract.second_pass(labels, [b[2] for b in found], [len(b[0]) for b in found])
    dropped = [b[0] for b, label, k in zip(found, labels, keep, strict=True) if label == "short" and not k]
    assert dropped == ["Menu", "Sign in", "More", "All rights"]
    assert html_extract.main_text(html) == f"River\n{LONG.strip()}\nShort.\n{LONG.strip()}\nEnd."


def test_pages_of_open_elements_take_time_in_proportion():
    import time

    for html in ("<aside>" * 100_000 + f"<p>{LONG}" * 1000, "<div><i><p>" + "<b>" * 100_000 + "</i>" * 100_000, "<p><li>" * 50_000, "<div>" * 100_000 + "</p>" * 100_000):
        began = time.time()
        html_extract.main_text(html)
        assert time.time() - began < 5


def test_page_table(spark):
    rows = [(1, "u", None, "z"), (2, None, "<p>x", "z"), (2, None, "<p>x", "z")]
    got = html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == [(1, "", 0), (2, "x", 1), (2, "x", 1)]


# --- mixing ------------------------------------------------------------------------------------


def test_mix_meets_targets(spark):
    rng = random.Random(6)
    texts = [None, "", "  "] + [words(rng, rng.randrange(1, 400)) for _ in range(400)]
    sources = [None, "a", "b"] + [rng.choice(["a", "a", "a", "b", "c", None]) for _ in range(400)]
    table = docs(spark, texts, sources)
    got = mixing.mix_sources(table).collect()
    assert len(got) == len(texts) and sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_sources(table.repartition(7)).collect()))
    by = {}
    for r in got:
        assert r.size == len((texts[r.doc_id] or "").split()) and 0 <= r.taken <= 2 * r.size
        entry = by.setdefault(sources[r.doc_id], [0, r.target, r.source_size])
        entry[0] += r.taken
    total = sum(s for _, _, s in by.values())
    assert sum(t for _, t, _ in by.values()) == pytest.approx(1.5 * total)
    for taken, target, size in by.values():
        assert target <= 2 * size and taken == pytest.approx(target, rel=0.02)
    weights = dict(zip(["a", "b", "c", None], [5, 2, 1, 5], strict=True))
    free = {round(t / weights[k], 6) for k, (_, t, s) in by.items() if t < 2 * s - 1e-6}
    assert len(free) <= 1


def test_mix_of_repeated_rows_and_a_very_long_text(spark):
    rows = [(1, "a b c", "x")] * 4 + [(2, "w " * 300_000, "y"), (None, "n o", None), (1, "other words here", "y")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "doc_id as size", "doc_id as target", "text as src", "text as taken")
    got = mixing.mix_sources(table).collect()
    assert sorted((r.doc_id or 0, r.size, r.source_size) for r in got) == [(0, 2, 2)] + [(1, 3, 12)] * 4 + [(1, 3, 300_003), (2, 300_000, 300_003)]
    assert all(0 <= r.taken <= 2 * r.size for r in got) and all(r.target <= 2 * r.source_size for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(table.repartition(5)).collect()), key=str)


def test_mix_of_nothing(spark):
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    assert [tuple(r) for r in mixing.mix_sources(docs(spark, [None])).collect()] == [(0, 0, 0, 0.0, 0)]


# --- quality ----------------------------------------------------------------------------------------


def test_quality_learns_and_ignores_the_fold(spark):
    rng = random.Random(3)
    texts = [None, "", "x"] + [words(rng, 60) if i % 3 else "BUY!! NOW!! " * 20 for i in range(600)]
    table = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(3, 603)] + [(3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_documents(table, labels).collect()}
    import zlib

    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    assert all(got[i].predicted == int(bool((i - 3) % 3)) for i in range(3, 603) if got[i].held_out)


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_documents(docs(spark, ["a", None]), none).collect()} == {0.5}
    assert quality.score_documents(docs(spark, []), none).count() == 0


def statistics_by_brute_force(text):
    import re

    raw = text.encode()
    share = lambda some, all_: some / max(all_, 1)
    bytes_of = {
        "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t", "high": bytes(range(128, 256)),
        "stop": b".!?", "comma": b",;:", "symbol": b"#$%&*+=<>@^_~|\\/{}[]", "shout": b"!", "line": b"\n",
    }
    out = [np.log1p(len(raw))] + [share(sum(b in bytes_of[k] for b in raw), len(raw)) for k in quality.CLASSES]
    words_ = re.findall(rb"[^\x20\x09-\x0D]+", raw.lower())
    sizes = [len(w) for w in words_]
    mean = share(sum(sizes), len(sizes))
    out += [np.log1p(len(words_)), mean, np.sqrt(max(share(sum(x * x for x in sizes), len(sizes)) - mean**2, 0))]
    kinds, pairs = Counter(words_), Counter(zip(words_, words_[1:]))
    out += [np.log1p(max(sizes, default=0)), share(len(kinds), len(words_)), share(max(kinds.values(), default=0), len(words_)), share(sum(n == 1 for n in kinds.values()), len(words_))]
    out += [share(len(pairs), sum(pairs.values())), share(max(pairs.values(), default=0), sum(pairs.values()))]
    letters = re.findall(rb"[a-z\x80-\xff]+", raw.lower())
    stops = {w.encode() for w in html_extract.STOP_WORDS}
    out += [share(sum(w in stops for w in letters), len(letters)), share(sum(len(w) == 1 for w in letters), len(letters)), share(sum(len(w) > 16 for w in letters), len(letters))]
    lines = [x for x in re.split(rb"[\r\n]", raw) if x]
    many = Counter(lines)
    n = max(len(lines), 1)
    return out + [np.log1p(n), sum(x > 1 for x in many.values()) / n, len(many) / n, sum(map(len, lines)) / n, sum(x[-1] in b".!?" for x in lines) / n]


def test_statistics_match_brute_force():
    rng = random.Random(9)
    texts = ["", "two words", "The cat. THE dog!\r\nthe cat.\n\nÉté à la plage, 12 % #x", "ab " * 5000 + "\n", "one line\none line\nend?"]
    texts += ["".join(rng.choice("aAbz the of  .,!?9#\n\t日é") for _ in range(rng.randrange(20, 400))) + " a b" for _ in range(40)]
    raw = [t.encode() for t in texts]
    got = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert np.allclose(got, [statistics_by_brute_force(t) for t in texts])


def test_training_does_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(12)
    rows = [(i % 150, words(rng, 40) if i % 2 else "BUY!! NOW!! " * 20) for i in range(400)] + [(None, "x"), (7, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)], "doc_id long, quality int")
    named = lambda some: spark.createDataFrame(some, "doc_id long, text string").selectExpr("*", "text as score", "text as y", "text as x", "text as id")
    one, other = (sorted(map(tuple, quality.score_documents(named(x), labels).collect()), key=str) for x in (rows, rows[::-1]))
    assert one == other and len(one) == len(rows)


def test_flat_trees_match_walking_them():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4))
    forest = quality.fit(x, (x[:, 0] + x[:, 1] > 0).astype(float))

    def walk(row):
        out = forest.base
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            for _ in range(quality.DEPTH):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            out += leaf[node - (2**quality.DEPTH - 1)]
        return 1 / (1 + np.exp(-out))

    assert np.allclose(forest.score(x), [walk(r) for r in x])


# --- quotations --------------------------------------------------------------------------------------


def test_quotations(spark):
    mail = [
        ("t", 0, "Hello there\nhow are you"), ("t", 1, "> Hello  THERE\nfine"), ("t", 2, ">> Hello there\n> fine\nglad"), ("t", 3, "> unknown line\nnew topic"),
        ("t", 4, "> how are you\n> glad\n> fine\nboth"), ("u", 0, "> fine\nno such thread"), ("u", None, "x"), ("u", 1, None),
    ]
    got = {(r.thread, r.seq): r for r in quotations.link_quotations(spark.createDataFrame(mail, "k string, n long, body string"), "k", "n", "body").collect()}
    assert len(got) == 7
    assert [(got["t", i].parent, got["t", i].root, got["t", i].depth) for i in range(5)] == [(None, 0, 0), (0, 0, 1), (1, 0, 2), (None, 3, 0), (2, 0, 3)]
    assert got["t", 2].text == "glad" and got["u", 0].parent is None and got["u", 1].text == "" and got["t", 4].quoted == 3


def linked_by_brute_force(mail):
    """``parent, root, place, quoted`` of each message of (thread, seq, body) rows."""
    parts = {}
    for t, i, body in mail:
        runs = []
        for line in (body or "").split("\n"):
            bare = line.lstrip("> ")
            level, content = line[: len(line) - len(bare)].count(">"), " ".join(bare.lower().split())
            if content and runs and runs[-1][0] == level:
                runs[-1][1].append(content)
            elif content:
                runs.append((level, [content]))
        parts[t, i] = runs
    said = {}
    for (t, i), runs in parts.items():
        for level, lines in runs:
            if level == 0:
                for x in {*lines, "\n".join(lines)}:
                    said.setdefault((t, x), []).append(i)
    latest = lambda t, x, i: max((j for j in said.get((t, x), []) if j < i), default=None)
    out = {}
    for (t, i), runs in sorted(parts.items()):
        votes = {}
        for level, lines in runs:
            for x, whole, one in [("\n".join(lines), len(lines), int(len(lines) == 1))] + [(x, 0, 1) for x in lines if len(lines) > 1]:
                j = latest(t, x, i)
                if level and j is not None:
                    w, o = votes.get((level, j), (0, 0))
                    votes[level, j] = (w + whole, o + one)
        parent = max(((-level, max(v), j) for (level, j), v in votes.items()), default=(0, 0, None))[2]
        out[t, i] = (parent, i if parent is None else out[t, parent][1], sum(o for _, o in votes.values()))
    return {(t, i): (p, r, sum(1 for (u, j), x in out.items() if u == t and x[1] == r and j <= i), q) for (t, i), (p, r, q) in out.items()}


@pytest.mark.parametrize("stretch", [3, 1024])
def test_quotations_match_brute_force(spark, monkeypatch, stretch):
    monkeypatch.setattr(quotations, "STRETCH", stretch)
    rng = random.Random(stretch)
    mail = []
    for t in "ab":
        for i in range(0, 60, 2):
            quotes = [f"{'>' * rng.choice([1, 1, 2])} {line}" for line in rng.sample([x.lstrip("> ") for _, _, b in mail for x in b.split("\n")] or ["none"], min(len(mail), rng.randrange(4)))]
            copied = [f"> {x}" for x in mail[-1][2].split("\n")] if mail and rng.random() < 0.5 else []
            mail.append((t, i, "\n".join(quotes + copied + rng.sample(["OK", "thanks  a lot", f"note {i % 6}", f"own {i}", "", "see below"], 3))))
    mail.append(("c", 5, "> " + "long " * 200_000 + "\n" + "word\n" * 3000))
    table = spark.createDataFrame(mail + mail[:5], "k string, n long, body string").selectExpr("*", "body as text", "n as root", "n as stretch", "k as thread", "n as seq")
    got = quotations.link_quotations(table, "k", "n", "body").collect()
    assert len(got) == len(mail) + 5
    assert {(r.thread, r.seq): (r.parent, r.root, r.place, r.quoted) for r in got} == linked_by_brute_force(mail)


def test_repeated_turns_are_told_apart(spark):
    mail = [("t", 0, "first\nok"), ("t", 1, "> first\n> ok\nok"), ("t", 2, "> first\n> ok\nno"), ("t", 3, "> ok\nyes"), ("t", 4, "new"), ("t", 5, "> yes\nend")]
    got = {r.seq: (r.parent, r.root, r.place) for r in quotations.link_quotations(spark.createDataFrame(mail, "k string, n long, body string"), "k", "n", "body").collect()}
    assert got == {0: (None, 0, 1), 1: (0, 0, 2), 2: (0, 0, 3), 3: (1, 0, 4), 4: (None, 4, 1), 5: (3, 0, 5)}


def test_derived_mail_links_to_the_turn_before(spark):
    turns = spark.createDataFrame([(c, i, "user", f"line {c} {i}\nmore {i}") for c in range(3) for i in range(40)], "conv_id long, turn long, role string, text string")
    got = quotations.link_quotations(quotations.quoting_messages(turns), "conv_id", "turn", "body").collect()
    assert all((r.parent, r.root, r.depth) == ((r.seq - 1, 0, r.seq) if r.seq else (None, 0, 0)) for r in got) and len(got) == 120
    assert all(r.text == f"line {r.thread} {r.seq}\nmore {r.seq}" for r in got)
    assert quotations.link_quotations(quotations.quoting_messages(turns.where(F.lit(False))), "conv_id", "turn", "body").count() == 0
