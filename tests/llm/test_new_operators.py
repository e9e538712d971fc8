"""Alignment, exact de-duplication and periodic runs next to brute force, with nulls, empties, ties, copies and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from scanlake.llm import alignment, exact_dedup, runs
from scanlake.llm.queries import periodic_tail, tokenizer_path

SCHEMA = "doc_id long, text string, row string, sha string, block int, slice long, pairs int, best double, id string"
SPACE = re.compile(r"[\x20\x09-\x0D]")


def words(g: random.Random, n: int) -> str:
    return " ".join("".join(g.choice("abcdeé") for _ in range(g.randrange(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    g = random.Random(5)
    base = words(g, 90)
    out = [(1, base), (2, base), (3, None), (4, ""), (5, " \t\n "), (6, "one"), (7, "x" * 3000), (8, base.replace(" ", "  ")), (9, base.replace(" ", "")),
           (9, base.replace(" ", "\n ")), (9, base.replace(" ", "\n ")), (None, base), (None, words(g, 60)), (None, None), (10, words(g, 30_000)),
           (11, "a b " * 40), (12, "na " * 9 + words(g, 5) + " c d e" * 7), (13, "one▁two"), (14, "<s> </s> <|endoftext|> <unk> <0x41> a  b c\x00"),
           (15, "日本語 テスト، العربية 🙂 é é"), (16, " lead"), (17, "trail  "), (18, "it's we'll\r\n\tx"), (2**62, "big"), (-5, "minus")]
    return out + [(20 + i, words(g, g.randrange(1, 120)) + " tail" * g.randrange(12)) for i in range(60)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "r", "s", 1, 2, 3, 0.5, "i") for i, t in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def number(x):
    return None if x is None or x != x else int(x)


def slow_alignment(rows):
    """The contract, word for word: pairs of intervals by comparison."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    ta, tb = Tokenizer.from_file(tokenizer_path()), SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    ta.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()
    docs, count = [], Counter()
    for i, t in rows:
        t = t or ""
        a = ta.encode(" " + t, add_special_tokens=False).ids if t else []
        b = tb.encode(t)
        raw_a = [bytes(alphabet[c] for c in ta.id_to_token(x)) for x in a]
        raw_b = [bytes([int(tb.id_to_piece(x)[3:5], 16)]) if tb.is_byte(x) else tb.id_to_piece(x).replace("▁", " ").encode() for x in b]
        want = (" " + t).encode()
        if b"".join(raw_a) != want or b"".join(raw_b) != want:
            a, b, raw_a, raw_b = [], [], [], []
        ends = [np.cumsum([0, *map(len, r)]).tolist() for r in (raw_a, raw_b)]
        links = []
        k = 0
        for x in range(len(a)):
            while k and ends[1][k] > ends[0][x]:
                k -= 1
            while k < len(b) and ends[1][k] < ends[0][x + 1]:
                if ends[1][k + 1] > ends[0][x]:
                    links.append((a[x], b[k]))
                k += 1
        count.update(links)
        both = sorted(set(ends[0]) & set(ends[1]))
        groups = ["|".join(",".join(str(ids[x]) for x in range(len(ids)) if lo <= e[x] < hi) for ids, e in ((a, ends[0]), (b, ends[1]))) for lo, hi in zip(both, both[1:])] if len(a) < 3000 else None
        docs.append((i, a, b, len(both) - 1 if a else 0, links, groups))
    high = Counter()
    for (_, y), n in count.items():
        high[y] = max(high[y], n)
    out = Counter()
    for i, a, b, n, links, groups in docs:
        sha = None if groups is None else hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out[i, len(a), len(b), n, len(links), sum(count[p] == high[p[1]] for p in links), sum(count[p] for p in links), sha] += 1
    return out


def test_alignment(docs, rows, none):
    got = alignment.align(docs, tokenizer_path(), tokenizer_path("piece_bpe_32k.model")).collect()
    assert got[0].__fields__ == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter((*r[:7], None if r.n_a >= 3000 else r.groups_sha256) for r in got) == slow_alignment(rows)
    assert {r.doc_id for r in got if not r.n_a} == {3, 4, 13, None}
    assert alignment.align(none, tokenizer_path(), tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_alignment_of_pieces_equals_whole_text():
    """Cutting a long text changes neither ids nor digest."""
    both = alignment.pair_of(tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    g = random.Random(6)
    for _ in range(30):
        t = "".join(g.choice([" ", "  ", "\n", "\t ", " ", "▁"][: 5]) + words(g, g.randrange(1, 4)) + g.choice(["", "'s", ".", "é?", " 12"]) for _ in range(60))
        parts = alignment.cut(t, 50)
        assert "".join(parts) == " " + t and len(parts) > 3
        for encode in (both.encode_a, both.encode_b):
            assert np.concatenate(encode(parts)).tolist() == encode([" " + t])[0].tolist()
    long = words(g, 60_000)
    (cut_doc,), links = alignment.align_texts(both, [long])
    whole = alignment.Document()
    a, b = both.encode_a([" " + long])[0], both.encode_b([" " + long])[0]
    assert links.tolist() == alignment.align_pieces(both, [(whole, a, b)]).tolist()
    assert (cut_doc.n_groups, cut_doc.n_links, cut_doc.digest()) == (whole.n_groups, whole.n_links, whole.digest())
    assert cut_doc.n_links == len(a) + len(b) - cut_doc.n_groups


def test_alignment_with_many_slices_equals_few(docs):
    paths = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
    slices = alignment.aligned_slices(docs.repartition(1), *paths, most=2000).collect()
    assert len(slices) > 3 and len({r.slice for r in slices}) == len(slices) and sum(len(r.doc_id) for r in slices) == docs.count()
    assert Counter(alignment.align(docs, *paths, most=2000).collect()) == Counter(alignment.align(docs, *paths).collect())


def slow_copies(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), i is None, i or 0, k))
    out = Counter()
    for text, g in groups.items():
        first = min(g)
        for _, null, i, k in g:
            out[None if null else i, None if first[1] else first[2], len(g), k == first[3], hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


def test_exact_dedup(docs, rows, none):
    got = exact_dedup.mark_copies(docs)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = slow_copies(rows)
    assert Counter(tuple(r) for r in got.collect()) == want
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    stays = Counter((i, s) for (i, _, _, k, s), n in want.items() for _ in range(n) if k)
    assert Counter((r.doc_id, hashlib.sha256(SPACE.sub("", r.text or "").encode()).hexdigest()) for r in kept.collect()) == stays
    assert exact_dedup.mark_copies(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


def test_exact_dedup_of_a_hot_group(spark):
    """A third of the rows is one text: its rows take the broadcast way, and each row has one result."""
    g = random.Random(8)
    rows = [(i, "hot text" if i % 3 == 0 else words(g, 6) if i % 3 == 1 else f"pair {i // 6}") for i in range(9000)]
    got = exact_dedup.mark_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert Counter(tuple(r) for r in got) == slow_copies(rows)


def test_filter_lets_unique_rows_pass(spark):
    """About 2 % of unique rows meet another by chance; repeated ones always do."""
    rows = spark.range(40_000).selectExpr("id", "unhex(sha2(encode(cast(if(id < 1000, id div 2, id) as string), 'UTF-8'), 256)) as sha")
    blocks = exact_dedup.blocks_for(40_000)
    found = exact_dedup.maybe_repeated(rows, exact_dedup.repeat_filter(rows, blocks), blocks).filter("_again")
    assert found.filter("id < 1000").count() == 1000
    assert found.count() - 1000 < 39_000 * 0.03
    plan = found.groupBy().count()._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "BroadcastHashJoin" in plan
    assert exact_dedup.blocks_for(10**12) == exact_dedup.BLOCKS_MOST


def slow_runs(x):
    n, out = len(x), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            w = x[i: j + q]
            if j > i and len(w) >= max(6, 4 * q) and not any(w[r:] == w[:-r] for r in range(1, q)):
                out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_find_runs():
    g = random.Random(2)
    for _ in range(600):
        n, k = g.randrange(1, 150), g.choice([1, 2, 2, 3, 5, 50])
        x = [g.randrange(k) for _ in range(n)]
        for _ in range(g.randrange(3)):
            p, a = g.randrange(1, 20), g.randrange(n)
            x[a: a + 7 * p] = ([g.randrange(k) for _ in range(p)] * 10)[: g.randrange(4 * p, 9 * p)]
        x *= g.choice([1, 1, 1, 2, 5])
        assert [(s, e - s, q) for s, e, q in runs.find_runs(np.array(x, np.int64), len(x))] == slow_runs(x)
    assert runs.find_runs(np.zeros(0, np.int64), 0) == []


def test_occurrences_are_exact():
    """Zeros of the sum of squared differences are the occurrences, also with numbers that need more primes."""
    g = np.random.default_rng(4)
    for size, most in ((1, 3), (4, 2), (64, 2), (256, 1 << 20), (1024, 1 << 24)):
        b, w = g.integers(0, most, (5, size)).astype(np.uint64), g.integers(0, most, (5, 2 * size)).astype(np.uint64)
        for i in range(4):
            w[i, i * size // 5: i * size // 5 + size] = b[i]
        w[4, :size] = b[4]
        w[4, size - 1] = (b[4, size - 1] + np.uint64(1)) % np.uint64(most)
        want = np.array([[(w[i, t: t + size] == b[i]).all() for t in range(size)] for i in range(5)])
        assert (runs.occurrences(b, w, most) == want).all() and want[:4].any(axis=1).all()
    with pytest.raises(ValueError):
        runs.occurrences(b, w, 1 << 45)


def test_transform_is_inverted():
    x = np.random.default_rng(1).integers(0, 2**31 - 2**27, (3, 64)).astype(np.uint64)
    for p, r in runs.PRIMES:
        assert (runs.inverse_transform(runs.transform(x % np.uint64(p), p, r), p, r) == x % np.uint64(p)).all()


def test_periodic_runs(docs, rows, none):
    got = runs.digests(runs.collapse_runs(docs, edit=periodic_tail)).collect()
    want, planted = Counter(), 0
    for i, t in rows:
        w = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
            planted += 1
        if len(w) > 5000:  # too long for the slow way; random words
            found = [tuple(r) for r in runs.find_runs(np.unique(w, return_inverse=True)[1], len(w))]
            found = [(s, e - s, q) for s, e, q in found]
        else:
            found = slow_runs(w)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
        digest = [hashlib.sha256(x).hexdigest() for x in ("".join("%d,%d,%d\n" % r for r in found).encode(), b" ".join(x for k, x in enumerate(w) if k not in gone))]
        want[(i, len(found), *best, 1000 * best[1] // best[2] if found else None, *digest)] += 1
    assert planted > 3 and sum(r[1] > 0 for r in want) > 10
    assert Counter(tuple(r) for r in got) == want
    assert runs.digests(runs.collapse_runs(none)).count() == 0


def test_collapsed_text(spark):
    d = spark.createDataFrame([(1, "x " + "go on " * 5 + "end"), (2, "plain\ttext"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.text, [tuple(x) for x in r.runs]) for r in runs.collapse_runs(d).collect()}
    assert got == {1: ("x go on end", [(1, 10, 2)]), 2: ("plain text", []), 3: ("", [])}


def test_a_worker_holds_the_look_ups_of_one_operator():
    from scanlake.llm.common import hold

    dropped = []
    hold("a", lambda: dropped.append("a"))
    hold("a", lambda: dropped.append("a"))
    assert dropped == []
    hold("b", lambda: dropped.append("b"))
    hold("a", lambda: dropped.append("a"))
    assert dropped == ["a", "b"]
