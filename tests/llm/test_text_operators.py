"""Text operators against brute force, on small tables with nulls, ties, copies and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, line long, rid long"


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Épée", "naïve", "日本", "x,", "y."]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage = text(60)
    out = []
    for i in range(n):
        t = "\n".join(text(rng.randint(3, 40)) for _ in range(rng.randint(1, 5)))
        if i % 5 == 0:
            t += "\n" + passage
        out.append(t)
    near = out[3].split(" ")
    for k in (5, 9, 20):
        v = list(near)
        v[k % len(v)] = "changed"
        out.append(" ".join(v))
    out += [out[2], out[2], None, "", " \t\n ", "one", "one two", "A b C d e f", "a B c D e f", "long " * 4000, "x" * 5000]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    texts = corpus()
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "n", 1, 2) for i, t in enumerate(texts)]
    rows += [(None, texts[0], None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (7, texts[7], "en", "s", 1, "n", 1, 2)]
    return spark.createDataFrame(rows, DOCS)


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def empty(docs):
    return docs.where("false")


# --- packing -------------------------------------------------------------------------


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    from traceloom.llm.packing import pack
    from traceloom.llm.queries import TOKENIZER

    t = Tokenizer.from_file(TOKENIZER)
    out = pack(docs, TOKENIZER, with_ids=True, group_pieces=16).collect()
    want = collections.Counter((d, tuple([*t.encode(x or "", add_special_tokens=False).ids, 0])) for d, x in rows_of(docs))
    by_doc = collections.defaultdict(list)
    for r in out:
        ids = np.frombuffer(r["ids"], dtype="<u4")
        assert len(ids) == r["length"] <= 1024 and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        by_doc[r["doc_id"], r["doc_tokens"]].append((r["start"], ids))
    got = sum(len(x) for parts in by_doc.values() for _, x in parts)
    assert got == sum(len(x) * n for (_, x), n in want.items())
    for (d, x), n in want.items():
        if n == 1 and d is not None:
            parts = sorted(by_doc[d, len(x)], key=lambda p: p[0])
            assert np.concatenate([p for _, p in parts]).tolist() == list(x)
    bins = collections.defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert pack(empty(docs), TOKENIZER).count() == 0


def test_unit_cache_equals_the_tokenizer():
    from traceloom.llm import packing
    from traceloom.llm.queries import TOKENIZER

    tok = packing.UnitTokenizer(TOKENIZER)
    rng = random.Random(2)
    bits = [" ", "\n", "  ", "\n\n", " \n", "a", "Bc", "é", "don't", "12", ",", "...", "\t", "\xa0", "<|endoftext|>", "日本", "'s", "\0", "é,", "a.b", "\u200b", "\u3000", "…", "\n", "It", "!?", "\u00e9.", "\u00f7", "x***", "(", "'ll", "longer-than-sixteen-bytes"]
    for _ in range(1500):
        s = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert tok.encode_all([s.encode()])[0] == np.array(tok.inner.encode(s, add_special_tokens=False).ids, dtype="<u4").tobytes()
    packing.SPAN, kept = 50, packing.SPAN
    try:
        s = "some words, and more\nof them " * 30
        assert tok.encode_all([s.encode()])[0] == np.array(tok.inner.encode(s, add_special_tokens=False).ids, dtype="<u4").tobytes()
    finally:
        packing.SPAN = kept


def test_merges_of_words_equal_the_tokenizer():
    from tokenizers import Tokenizer

    from traceloom.llm.packing import WordMerges
    from traceloom.llm.queries import TOKENIZER

    inner = Tokenizer.from_file(TOKENIZER)
    merges, rng = WordMerges(inner), random.Random(8)
    assert merges.agrees
    parts = ["th", "e", "in", "ing", "st", "qu", "a", "an", "ss", "er", "on", "X", "Le", "zz", "ab", "\u00e9", "\u00dfe", "\u00d1"]
    units = [rng.choice(["", " "]) + "".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(20000)]
    raw = [u.encode() for u in units]
    plain, flat, count = merges.encode(raw)
    assert sorted(plain) == [k for k, u in enumerate(raw) if len(u) <= merges.LONGEST]
    ends = np.cumsum(count)
    assert all(flat[z - n : z].tolist() == inner.encode(units[k], add_special_tokens=False).ids for k, n, z in zip(plain, count, ends, strict=True))
    assert merges.encode([b"a b", b"it's", "\u00d7".encode(), b"12", b"  a", b"\n", "\u65e5".encode()])[0] == []


def test_unit_table_that_fills_up():
    from traceloom.llm import packing
    from traceloom.llm.queries import TOKENIZER

    tok = packing.UnitTokenizer(TOKENIZER)
    tok.table = packing.UnitTable(4)
    for part in range(4):
        texts = [f"w{part}x{i} and y{i % 7}, z" for i in range(40)] + [""]
        want = [np.array(tok.inner.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
        assert tok.encode_all([t.encode() for t in texts]) == want


def test_first_fit_decreasing_equals_a_scan():
    from traceloom.llm.packing import first_fit_decreasing

    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 50, 333):
        sizes = rng.integers(1, 101, n)
        room, want = [], {}
        for i in np.argsort(-sizes, kind="stable"):
            k = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
            room += [100] * (k == len(room))
            want[i] = (k, 100 - room[k])
            room[k] -= sizes[i]
        bins, offsets = first_fit_decreasing(sizes, 100)
        assert [(bins[i], offsets[i]) for i in range(n)] == [want[i] for i in range(n)]


# --- n-gram Jaccard join -------------------------------------------------------------


def shingle_sets(rows, k):
    out = []
    for _, t in rows:
        w = SPACE.findall((t or "").encode().lower())
        out.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    return out


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80), (2, 50)])
def test_jaccard_join(docs, k, num):
    from traceloom.llm.jaccard_join import jaccard_components

    rows = rows_of(docs)
    sets = shingle_sets(rows, k)
    n = len(rows)
    links = [[j for j in range(n) if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])] for i in range(n)]
    want = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        want.append((rows[i][0], len(sets[i]), min(ids) if ids else None, len(links[i])))
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_components(docs, k, num, 100, count_links=True).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("num", [90, 100])
def test_jaccard_join_at_the_bounds_of_sizes(spark, num):
    """Pairs of a text and its beginning whose sizes are just near enough, or just not."""
    from traceloom.llm.jaccard_join import jaccard_components

    rows, want = [], []
    for n, m in [(9, 10), (8, 9), (18, 20), (17, 19), (27, 30), (81, 90), (80, 90), (90, 100), (89, 100), (450, 500), (449, 500), (900, 1000), (3, 3), (1, 1), (700, 700)]:
        words = [f"w{len(rows)}x{i}" for i in range(m + 2)]
        first = len(rows)
        rows += [(first, " ".join(words[: n + 2])), (first + 1, " ".join(words))]
        want += [(first, n, first), (first + 1, m, first if 100 * n >= num * m else first + 1)]
    rows.append((len(rows), rows[0][1].upper()))
    want.append((len(rows) - 1, 9, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in jaccard_components(docs, 3, num, 100).collect()]
    assert sorted(got) == sorted(want)


def test_jaccard_join_of_clusters(spark):
    """Edited copies of some texts, most of them not linked with each other, many to a cluster."""
    from traceloom.llm.jaccard_join import jaccard_components

    rng = random.Random(11)
    out = []
    for c in range(6):
        base = [f"c{c}w{rng.randrange(400)}" for _ in range(rng.choice([60, 150, 400]))]
        for _ in range(40):
            v = list(base)
            for _ in range(rng.randint(0, len(v) // 25 + 1)):
                v[rng.randrange(len(v))] = f"n{rng.randrange(10**6)}"
            out.append(" ".join(v))
    rows = [(i // 2 if i % 7 == 0 else i, t) for i, t in enumerate(out)]
    sets = shingle_sets(rows, 3)
    leader = list(range(len(rows)))

    def find(i):
        while leader[i] != i:
            i = leader[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 90 * len(a | sets[j]):
                leader[find(i)] = find(j)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        smallest[find(i)] = min(d, smallest.get(find(i), d))
    want = [(d, len(sets[i]), smallest[find(i)]) for i, (d, _) in enumerate(rows)]
    got = [tuple(r) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()]
    assert sorted(got) == sorted(want)


def test_sieve_lets_all_members_pass(spark):
    from traceloom.llm.scratch import sieve

    rows = spark.range(20000).selectExpr("xxhash64(id) AS k", "id")
    kept = sieve(rows, rows.where("id % 7 = 3").select("k"), "k")
    assert kept.where("id % 7 = 3").count() == rows.where("id % 7 = 3").count()
    assert kept.count() < 3000 and sieve(rows, rows.where("false"), "k").count() == 0


def test_jaccard_join_of_nothing_and_one_of_each(docs):
    from traceloom.llm.jaccard_join import jaccard_components, one_of_each

    assert jaccard_components(empty(docs)).count() == 0
    out = one_of_each(docs)
    assert out.columns == docs.columns
    sets = [s for s in shingle_sets(rows_of(out), 5) if s]
    assert all(100 * len(a & b) < 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert out.where("text is null or text = ''").count() == docs.where("text is null or text = ''").count()


def test_jaccard_join_ends_without_further_pairs(spark, monkeypatch):
    """Dead plans are let go while it runs, and a round without pairs has no verification and no components."""
    from traceloom.llm.jaccard_join import Linked
    from traceloom.llm.scratch import Scratch

    freed = []
    monkeypatch.setattr(Scratch, "free", lambda self: freed.append(self.n), raising=False)
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(30)]
    rows = [(2 * i + k, t + " more" * k) for i, t in enumerate(texts) for k in range(2)]
    scratch = Scratch(spark, "test")
    linked = Linked(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100, "doc_id", "text", scratch)
    assert linked.parts.groupBy("component").count().where("count = 2").count() == 30
    # of them 5 for the one verification and 3 for the components
    assert scratch.n == 18 and len(freed) >= 4


# --- suffix-array dedup --------------------------------------------------------------


@pytest.mark.parametrize(("length", "slice_size"), [(200, 8192), (40, 8192), (40, 2)])
def test_suffix_dedup(docs, length, slice_size):
    from traceloom.llm.suffix_dedup import remove_repeats

    rows = [(d, (t or "").encode()) for d, t in rows_of(docs)]
    times = collections.Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    want = []
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if times[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        want.append((d, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    out = remove_repeats(docs, length, slice_size=slice_size, shard_bytes=4096)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in out.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_suffix_dedup_of_a_text_in_pieces(spark, monkeypatch):
    """Windows that are anchored in several pieces repeat like those in one."""
    from traceloom.llm import suffix_dedup

    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    texts = [base + "x" * 3 + base[500:900], "y" + base[100:2500], "z" * 150, "short"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    found = {}
    for piece in (64, 1 << 22):
        monkeypatch.setattr(suffix_dedup._anchored, "__defaults__", (piece,))
        out = suffix_dedup.remove_repeats(rows.selectExpr("text", "length(text) AS doc_id"), 40)
        found[piece] = sorted((r["doc_id"], bytes(r["kept"])) for r in out.collect())
    assert found[64] == found[1 << 22]


def test_suffix_dedup_of_nothing(docs):
    from traceloom.llm.suffix_dedup import remove_repeats

    assert remove_repeats(empty(docs)).count() == 0


def test_suffix_array_order_and_prefixes():
    from traceloom.llm.suffix_dedup import SuffixArray

    rng = random.Random(6)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(24, 60))) for _ in range(20)]
    windows = np.array([len(p) - 23 for p in parts])
    s = SuffixArray(parts, windows, 24)
    text = b"".join(parts)
    strings = [text[i : i + 24] for i in s.order]
    assert strings == sorted(strings)
    lcp = s.common_prefixes()
    for a, b in zip(s.order, s.order[1:]):
        assert (lcp[b] >= 24) == (text[a : a + 24] == text[b : b + 24])
    assert set(np.flatnonzero(s.met_in(s))) == set(s.at)


def test_suffix_arrays_of_a_shard_take_bounded_memory():
    """A shard of any size takes no more than some times the bytes of one array, with the same runs."""
    import tracemalloc

    import pyarrow as pa

    from traceloom.llm.suffix_dedup import repeated_windows

    rng = np.random.default_rng(5)
    rows = []
    for anchor in range(400):
        base = rng.integers(97, 101, 260).astype(np.uint8)
        for kind in range(24):
            part = base[kind:].copy()
            part[-1 - kind] = 65
            rows.append((anchor, len(rows), len(part) - 199, anchor % 3 // 2, 1, bool(kind % 2) and anchor % 3 < 2, part.tobytes()))
    shard = pa.table([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()])], names=["anchor", "segment", "windows", "i", "j", "second", "part"])
    size = sum(len(r[-1]) for r in rows)
    tracemalloc.start()
    found = repeated_windows(shard)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size > 2e6 and most < 90e6
    runs = lambda t: sorted(zip(*(t[c].to_pylist() for c in ("anchor", "segment", "a", "z"))))
    assert len(found) and runs(found) == runs(repeated_windows(shard, array_bytes=1))


# --- line dedup ----------------------------------------------------------------------


def test_patience_blocks_are_common_and_in_order():
    from traceloom.llm.line_dedup import patience_blocks

    rng = random.Random(8)
    for _ in range(300):
        a, b = ([rng.randrange(12) for _ in range(rng.randint(0, 14))] for _ in range(2))
        blocks = patience_blocks(a, b)
        last_a = last_b = 0
        for i, j, n in blocks:
            assert a[i : i + n] == b[j : j + n] and i >= last_a and j >= last_b and n > 0
            last_a, last_b = i + n, j + n
    assert patience_blocks([1, 2, 3, 9, 4], [1, 2, 3, 4]) == [(0, 0, 3), (4, 3, 1)]
    assert patience_blocks([5, 1, 2], [1, 2]) == [(1, 0, 2)]


def test_line_dedup(docs):
    from traceloom.llm.line_dedup import dedup_lines

    rows = rows_of(docs)
    held = collections.defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            held[x.strip(" \t\r\x0b\x0c")].add((d is None, d or 0, t))
    out = dedup_lines(docs)
    got = out.collect()
    assert sorted(map(repr, (r["doc_id"] for r in got))) == sorted(map(repr, (d for d, _ in rows)))
    known = collections.defaultdict(set)
    for d, t in rows:
        known[d].add(t)
    for r in got:
        assert len((r["text"] or "").split("\n")) >= 1 and (r["text"] is None) == (None in known[r["doc_id"]] and r["text"] is None)
        if r["__n_removed"] == 0:
            assert r["text"] in known[r["doc_id"]]
    assert out.columns[: len(docs.columns)] == docs.columns
    assert dedup_lines(empty(docs)).count() == 0


def test_lines_in_one_order_go_if_an_earlier_document_has_them(spark):
    """Documents take lines from one ordered list, so alignment can miss none: brute force is a set of lines seen."""
    from traceloom.llm.line_dedup import dedup_lines

    rng = random.Random(21)
    lines = [f"{i:04d} a line of its own {rng.random()}" for i in range(400)]
    everywhere, passage = set(range(100, 104)), set(range(200, 230))
    texts = []
    for d in range(60):
        own = {rng.randrange(400) for _ in range(rng.randint(0, 12))} | everywhere
        own |= passage if d % 4 == 1 else set()
        texts.append([lines[i] for i in sorted(own)] + [f"only {d} has this line, {rng.random()}"] * (d % 3))
    texts += [texts[7], texts[7], texts[9][:3] + texts[9][4:]]
    rows = [(d, "\n".join(t), d, 1, "x") for d, t in enumerate(texts)]
    rng.shuffle(rows)
    seen, want = set(), {}
    for d, t in enumerate(texts):
        want[d] = "\n".join(x for x in t if x not in seen)
        seen |= set(t)
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, gone int, __n_removed int, line string"))
    assert out.columns[:5] == ["doc_id", "text", "gone", "__n_removed", "line"] and out.columns[-1] == "___n_removed"
    assert {r[0]: r[1] for r in out.collect()} == want


def test_short_lines_and_blocks_beside_another_holder(spark):
    """Copies made of short lines go, and so does a block that begins with a line of a third document."""
    from traceloom.llm.line_dedup import dedup_lines

    short = "\n".join(f"s{i}" for i in range(30))
    block = ["a first line that is in all three"] + [f"b{i} tail" for i in range(20)]
    texts = [block[0] + "\nother text of the first document", "of two\n" + "\n".join(block), "of three\n" + "\n".join(block), short, short]
    out = {r[0]: r[1] for r in dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out[1] == "of two\n" + "\n".join(block[1:]) and out[2] == "of three" and out[3] == short and out[4] == ""


def longest_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("bits", [1 << 28, 6])
def test_gaps_without_unique_lines_are_aligned(monkeypatch, bits):
    from traceloom.llm import line_dedup

    monkeypatch.setattr(line_dedup, "MAX_BITS", bits)
    assert line_dedup.patience_blocks([9, 1, 8, 1, 7], [5, 1, 6]) == [(1, 1, 1)]  # twice in the later document
    assert line_dedup.patience_blocks([5, 1, 6], [9, 1, 8, 1, 7]) == [(1, 1, 1)]  # twice in its partner
    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 7))] * 2 for _ in range(2))  # nothing is unique
        a, b = [10, *a, 11], [12, *b, 13]
        blocks = line_dedup.patience_blocks(a, b)
        assert sum(n for _, _, n in blocks) == longest_common(a, b)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in blocks)


def test_lines_left_by_the_first_holder_meet_the_next(spark):
    from traceloom.llm.line_dedup import dedup_lines

    x, y, z = ("first line of a passage", "another line of a passage", "a last line of the passage")
    own = lambda k: f"only document {k} has this"
    texts = [f"{y}\n{x}", f"{x}\n{y}", f"{x}\n{y}", f"{z}\n{own(3)}", f"{z}\n{own(4)}\n{z}", *[f"{z}\n{own(k)}" for k in range(5, 9)], f"{z}\n{own(9)}\n{z}\n{own(10)}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in dedup_lines(docs).collect()}
    assert got[2] == ""  # a copy of 1, though its lines' first holder has them the other way round
    assert got[0] == texts[0] and got[3] == texts[3] and got[4].split("\n").count(z) == 1  # no earlier document has it twice
    assert got[9] == f"{own(9)}\n{own(10)}"  # document 4 has it twice


def test_blocks_of_short_lines_are_found(spark):
    from traceloom.llm.line_dedup import dedup_lines, short_runs

    verse = "roses are red\n\nviolets are blue\nand so"
    texts = [f"a\n{verse}\nb", f"c\n{verse}\nd", "roses are red\ne", f"{verse}\n" + "f" * 30, "g\nroses are red\n\nviolets are blue\nh", "x\n" * 30 + "i", "j\n" + "x\n" * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in dedup_lines(docs).collect()}
    assert got == {0: texts[0], 1: "c\nd", 2: texts[2], 3: "f" * 30, 4: "g\nh", 5: texts[5], 6: "j\n"}
    rng = random.Random(12)
    for _ in range(200):
        docs_lines = [[rng.choice([0, 1, 3, 7, 12, 19, 20, 40]) for _ in range(rng.randint(1, 12))] for _ in range(3)]
        sizes = np.array([x for d in docs_lines for x in d])
        ends = np.repeat(np.cumsum([len(d) for d in docs_lines]), [len(d) for d in docs_lines])
        at, n, key = short_runs(sizes.astype(np.uint64), sizes, ends, 20, 20)
        want = {}
        for a, z in enumerate(ends):
            for e in range(a + 1, z + 1):
                if sizes[a:e].sum() >= 20:
                    if sizes[a] and sizes[a:e].max() < 20:
                        want[a] = e - a
                    break
        assert dict(zip(at.tolist(), n.tolist())) == want
        parts = [tuple(sizes[a : a + k]) for a, k in zip(at, n)]
        assert len(set(zip(parts, key.tolist()))) == len(set(parts)) == len(set(key.tolist()))


def test_aligned_lines_hold_few_pairs_at_once():
    import tracemalloc

    import pyarrow as pa

    from traceloom.llm.line_dedup import aligned_lines

    lines = np.arange(1 << 40, (1 << 40) + 100)
    lists = pa.array([lines] * 4000, pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), lists, pa.array([[30] * 100] * 4000, pa.list_(pa.int32())), lists], ["doc", "hashes", "sizes", "other"])
    tracemalloc.start()
    found = sum(len(x) for b in aligned_lines(iter([batch]), 20) for x in b.column(1).to_pylist())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 4000 * 100 and most < 5e6


# --- quality rules -------------------------------------------------------------------


def test_rule_counts(spark, docs):
    from traceloom.llm.quality_rules import filter_documents, quality_rules

    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality_rules(docs, labels)
    want = []
    for d, t in rows_of(docs):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed))
    got = [tuple(r)[:7] for r in out.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert not out.where("base_failed and kept").count()
    kept = filter_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == out.where("kept").count()
    assert quality_rules(empty(docs), labels).count() == 0
    assert quality_rules(docs, labels.where("false")).where("not base_failed and not kept").count() == 0


def test_isolation_forest_ranks_outliers_first():
    from traceloom.llm.quality_rules import IsolationForest, calibrate

    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (2000, 5)), rng.normal(6, 1, (20, 5))])
    s = IsolationForest(trees=64).fit(x).score(x)
    assert s[2000:].min() > np.quantile(s[:2000], 0.97)
    t = calibrate(s, np.arange(len(x)) < 2000)
    assert (s[:2000] <= t).mean() >= 0.99
    assert calibrate(s, np.ones(len(x), dtype=bool)) == math.inf


def test_forest_and_threshold_come_from_all_rows(spark, monkeypatch):
    """Leaves are weighed by every row, and every labelled row counts, however few rows the trees draw."""
    from traceloom.llm import quality_rules as q
    from traceloom.llm.scratch import Scratch

    for name, value in (("TREES", 8), ("TREE_ROWS", 16)):
        monkeypatch.setattr(q, name, value)
    monkeypatch.setattr(q, "CALIBRATION_ROWS", 5, raising=False)  # there was such a cap
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice("abc#1") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(8, 30)))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(t.count("#") * 9 < len(t) * 1.4)) for i, t in rows], "doc_id long, quality int")
    c = q.rule_counts([t.encode() for _, t in rows])
    counts = q.counted(docs, "doc_id", "text")
    forest, threshold = q.fitted(counts, labels, Scratch(spark, "test")) if "scratch" in q.fitted.__code__.co_varnames else q.fitted(counts, labels)
    x, ok = q.statistics(c), ~q.base_failed(c)
    score, good = forest.score(x), np.array([t.count("#") * 9 < len(t) * 1.4 for _, t in rows])
    assert 0 < good[ok].sum() < ok.sum() < len(rows)
    assert threshold == q.calibrate(score[ok], good[ok])
    share = np.zeros(len(forest.column))
    for root, at in zip(forest.roots, forest.leaves(x[c["n_words"] >= q.MIN_WORDS])):
        share += np.bincount(at, minlength=len(share)) / len(at)
    leaf = forest.column < 0
    np.testing.assert_allclose(forest.length[leaf], (forest.depth + q._expected(16 * share))[leaf])


# --- language model ------------------------------------------------------------------


def test_language_model(docs):
    from traceloom.llm.language_model import score_documents

    rows = [(d, [*SPACE.findall((t or "").encode().lower()), None]) for d, t in rows_of(docs)]
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0
    c = collections.Counter(w for d, t in rows if not held(d) for w in t)
    n, v = sum(c.values()), len(c)
    want = [(d, held(d), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for d, t in rows]
    for common in (1 << 18, 5):
        out = score_documents(docs, common=common).collect()
        got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
        assert all(r["score"] < 0 for r in out)
    assert score_documents(empty(docs)).count() == 0


def test_class_model_is_a_distribution():
    from traceloom.llm.language_model import CLASSES, ClassModel, Tokens

    t = Tokens([b"a b c a b c a b c " * 50, b"", b"x y"])
    m = ClassModel(np.bincount(t.cls, minlength=CLASSES).astype(float))
    squares = np.ones(len(m.weights), dtype=np.float32)
    f = t.features(0, len(t.hash))
    before = m.log_probabilities(f, t.cls).sum()
    for _ in range(5):
        m.update(f, t.cls, squares)
    assert m.log_probabilities(f, t.cls).sum() > before
    every = np.stack([m.log_probabilities(f, np.full(len(t.hash), k)) for k in range(CLASSES)])
    assert np.allclose(np.exp(every).sum(axis=0), 1, atol=1e-4)


def test_language_model_beats_the_base_on_held_out_texts(spark):
    from traceloom.llm.language_model import score_documents

    out = score_documents(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    base, score = out.where("held_out").agg({"base_score": "sum", "score": "sum"}).select("sum(base_score)", "sum(score)").first()
    assert score > base


def cells_of(t):
    """Each token's cell and number in the training counts, from the tokens of one text after the other."""
    return list(zip(t.hash.tolist(), t.cls.tolist(), t.sub.tolist(), strict=True))


@pytest.mark.parametrize("rounds", [0, 2])
def test_score_equals_a_sum_token_by_token(docs, rounds):
    from traceloom.llm import language_model as L

    texts = [(d, (t or "").encode()) for d, t in rows_of(docs)]
    learn = [t for d, t in texts if zlib.crc32(b"" if d is None else str(d).encode()) % 10]
    c = collections.Counter(x for t in learn for x in cells_of(L.Tokens([t])))
    n = np.zeros((L.CLASSES, L.CLASSES))
    kinds = np.zeros_like(n)
    for (_, cls, sub), times in c.items():
        n[cls, sub] += times
        kinds[cls, sub] += 1
    if rounds:
        models = L.trained(docs, n, "doc_id", "text", rounds).models
        assert all(np.abs(m.weights).max() > 0 for m in models)
        weights = [m.weights.astype(np.float64) for m in models]

    def softmax(level, rows, prior, k):
        s = [math.log((p + 1) / sum(q + 1 for q in prior)) for p in prior]
        if rounds:
            s = [x + sum(weights[level][r][j] for r in rows) for j, x in enumerate(s)]
        return s[k] - math.log(sum(math.exp(x) for x in s))

    def score(text):
        t, total = L.Tokens([text]), 0.0
        for at, (h, cls, sub) in enumerate(cells_of(t)):
            total += softmax(0, t.features(at, at + 1)[:, 0], n.sum(axis=1), cls)
            if cls != L.END_CLASS:
                total += softmax(1, t.features(at, at + 1, within=True)[:, 0], n[cls], sub)
            total += math.log((c[h, cls, sub] + 0.1) / (n[cls, sub] + 0.1 * (kinds[cls, sub] + 1)))
        return total / math.log(10)

    want = sorted((repr(d), score(t)) for d, t in texts)
    for common in (1 << 18, 5):
        got = sorted((repr(r["doc_id"]), r["score"]) for r in L.score_documents(docs, common=common, rounds=rounds).collect())
        assert [d for d, _ in got] == [d for d, _ in want]
        assert np.allclose([s for _, s in got], [s for _, s in want], rtol=1e-4, atol=1e-4)


def test_subclass_model_learns_and_is_a_distribution():
    from traceloom.llm.language_model import CLASSES, END_CLASS, UNMET, Levels, Tokens

    t = Tokens([b"tab cab gab lab " * 50, b"", b"x y"])
    counts = np.bincount(t.cell, minlength=CLASSES * CLASSES).astype(float).reshape(CLASSES, CLASSES)
    levels, whole = Levels(counts), len(t.hash)
    squares, met = (np.full((2, len(levels.models[0].weights)), x, dtype=np.float32) for x in (1, UNMET))
    before = levels.log_probabilities(t, 0, whole)
    for _ in range(5):
        levels.update(t, 0, whole, squares, met)
    assert levels.log_probabilities(t, 0, whole).sum() > before.sum()
    words = np.flatnonzero(t.cls != END_CLASS)
    f = t.features(0, whole, within=True)[:, words]
    every = np.stack([levels.models[1].log_probabilities(f, np.full(len(words), k), t.cls[words]) for k in range(CLASSES)])
    assert np.allclose(np.exp(every).sum(axis=0), 1, atol=1e-4)
    assert round(met[0].sum()) == 5 * 4 * whole and round(met[1].sum()) == 5 * 4 * len(words)
