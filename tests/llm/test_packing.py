import functools
import random
import zlib

import numpy as np
import pyarrow as pa

from cityweave.llm import packing


def texts():
    r = random.Random(4)
    alphabet = ["a", "the", "É", "é", " ", "  ", "\n", " \n", "\t ", "'s", "don't", "12", ".", "!?", " ", "​", "\x1c", "\x85", "日本", "🎉", "<|endoftext|>", "x" * 30, "word,", "Été.", "a.b", "x\ny"]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(400)] + ["", " ", "  a", "a ", "a  ", "\n a", " a\n b  c \n"]


@functools.cache
def tokenizer():
    """The tokenizer as its file sets it up."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def plain_ids(t):
    return np.array(tokenizer().encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_equal_the_tokenizer(monkeypatch):
    path, own = packing.default_tokenizer(), tokenizer()
    want = [e.ids for e in own.encode_batch(texts(), add_special_tokens=False)]
    for most in (600_000, 50):
        monkeypatch.setattr(packing, "MEMO", most)
        memo = packing.Memo(path)
        for _ in range(2):
            assert [np.frombuffer(memo.ids(t), "<u4").tolist() for t in texts()] == want
        assert len(memo) <= most and len(memo.parts) <= most


def test_special_tokens_and_long_texts():
    memo = packing.Memo(packing.default_tokenizer())
    special = "a <|endoftext|> b"
    assert np.frombuffer(memo.ids(special), "<u4").tolist() == [64, 220, 50256, 275]
    r = random.Random(2)
    marks = ["", ".", ",", "!?", "'s", "'", "...\n", "\nAnd", "\n\n", "-é", "ß", "ª", "µ", "×", "÷", "7a7", "%%%", "\u0100", "\u00a0"]
    long = " ".join("".join(r.choice("abcdeéèñüÀ") for _ in range(r.randint(1, 9))) + r.choice(marks) for _ in range(60_000))
    for t in (special, "x" * 20_000, "x " * 20_000, long):
        assert memo.ids(t) == plain_ids(t)


def test_packer_bounds_and_best_fit():
    p = packing.Packer(10, 2)
    assert [p.put(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    assert [p.put(n) for n in (6, 8, 7, 4)] == [(2, 0), (3, 0), (4, 0), (2, 6)]


def test_pack(spark):
    r = random.Random(1)
    rows = [(k, " ".join(r.choice(["the", "of", "zebra", "é"]) for _ in range(r.choice([3, 40, 300, 1500])))) for k in range(150)] + [(900, None), (901, ""), (None, "lost"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, length int")
    for group in (10**6, 40):
        got = packing.pack(docs, group=group).collect()
        want = []
        for i, t in rows:
            ids = plain_ids(t) + np.array([2], "<u4").tobytes()
            n = len(ids) // 4
            cuts = [(0, n)] if n <= 1024 else [(s, e - s) for s, e in zip([0, *range(n % 1024 or 1024, n, 1024)], [*range(n % 1024 or 1024, n, 1024), n])]
            want += [(i, k, s, m, zlib.crc32(ids[4 * s : 4 * (s + m)])) for k, (s, m) in enumerate(cuts)]
        assert sorted((tuple(x)[:5] for x in got), key=str) == sorted(want, key=str)
        seq = {}
        for x in got:
            seq.setdefault(x.sequence_id, []).append((x.offset, x.length))
        for places in seq.values():
            reach = 0
            for o, n in sorted(places):
                assert o == reach
                reach += n
            assert reach <= 1024
        if group == 10**6:
            assert len(seq) <= 1.1 * sum(x.length for x in got) / 1024 + 1  # the lengths drawn here fit badly
    assert packing.pack(docs.limit(0)).count() == 0


def brute_best_fit(lengths, capacity, most):
    """Online best-fit over a plain list of open bins: the fullest that has room, of equal ones the last that came to that
    fill; a new bin closes the fullest one if too many are open."""
    bins, made, out = [], 0, []  # (free, bin), in the order in which they came to that fill
    for n in lengths:
        fits = [b for b in bins if b[0] >= n]
        if fits:
            least = min(f for f, _ in fits)
            at = max(k for k, b in enumerate(bins) if b[0] == least)
        else:
            if len(bins) >= most:
                least = min(f for f, _ in bins)
                bins.pop(max(k for k, b in enumerate(bins) if b[0] == least))
            bins.append((capacity, made))
            made += 1
            at = len(bins) - 1
        free, bin_ = bins.pop(at)
        out.append((bin_, capacity - free))
        if free > n:
            bins.append((free - n, bin_))
    return out


def test_packer_equals_brute_force():
    r = random.Random(5)
    for capacity, most, n in ((10, 2, 300), (64, 5, 600), (1024, 40, 2000)):
        lengths = [min(capacity, max(1, int(r.paretovariate(0.9) * capacity / 40))) for _ in range(n)]
        p = packing.Packer(capacity, most)
        assert [p.put(x) for x in lengths] == brute_best_fit(lengths, capacity, most)


def test_placement_equals_brute_force(spark):
    r = random.Random(6)
    rows = [(k, " ".join("the" for _ in range(r.choice([2, 30, 200, 700, 1023, 1100, 2300])))) for k in range(120)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), group=10**6, open_bins=4).collect()
    whole = [x for x in got if x.length == 1024]
    assert len({x.sequence_id for x in whole}) == len(whole) and all(x.offset == 0 and x.sequence_id < 0 for x in whole)
    part = sorted((x for x in got if x.length < 1024), key=lambda x: (x.sequence_id, x.offset))
    bins = {}
    for x in part:
        bins.setdefault(x.sequence_id, []).append(x.length)
    # replayed in the order in which sequences and offsets came, best-fit puts every piece where it is
    assert sum(map(sum, bins.values())) == sum(x.length for x in part) and all(sum(b) <= 1024 for b in bins.values())
    assert len(bins) <= len(brute_best_fit(sorted((x.length for x in part), reverse=True), 1024, 10**6)) + 4


def test_workers_let_go_of_the_memo(spark):
    from cityweave.llm import base

    docs = spark.createDataFrame([(k, "the of zebra") for k in range(40)], "doc_id long, text string").repartition(4)

    def asked(keeps):
        def each(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([len(base.remembered("packing"))] * len(b))], ["n"])

        return {r.n for r in base.map_batches(docs, each, "n long", keeps).collect()}

    for _ in range(3):
        packing.pieces(docs, packing.default_tokenizer()).count()
    assert 1 in asked("packing")
    assert asked("") == {0}
    assert asked("packing") == {0}
