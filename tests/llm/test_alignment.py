"""Cross-tokenizer alignment against plain Python that walks both token lists."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foreband.llm import alignment
from foreband.llm.common import table

OUT = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
BATCH_TEXTS = [
    "plain words, some more of them", "", None, "x", " ", "  two  blanks ", "Ünïcödé 東京タワー ß", "tab\tline\nreturn\r", "<|endoftext|> <s> </s> <unk> as text",
    "mark ▁ inside", "nul \x00 byte", "é́ combining", "🙂🙂 two faces", "a" * 3000, " " * 500, "no" + "​" + "break", "same row", "same row",
]


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_alphabet():
    shown = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    out, n = {chr(b): b for b in shown}, 0
    for b in range(256):
        if b not in shown:
            out[chr(256 + n)] = b
            n += 1
    return out


def plain(texts, libraries):
    """Rows of the contract, by lists and counters."""
    first, second = libraries
    alphabet, docs = byte_alphabet(), []
    for text in texts:
        groups = []
        if text:
            one, two = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
            a = [bytes(alphabet[c] for c in first.id_to_token(i)) for i in one]
            b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, second.id_to_piece(i)) for i in two)]
            if b"".join(a) == b"".join(b) == (" " + text).encode():
                i = j = at_a = at_b = 0
                left, right = [], []
                while i < len(a) or j < len(b):
                    if at_a <= at_b:
                        at_a += len(a[i])
                        left.append(one[i])
                        i += 1
                    else:
                        at_b += len(b[j])
                        right.append(two[j])
                        j += 1
                    if at_a == at_b:
                        groups.append((left, right))
                        left, right = [], []
        docs.append(groups)
    links = [Counter((x, y) for left, right in groups for x in left for y in right) for groups in docs]
    count = Counter(pair for d in links for pair in d)
    top = {}
    for (x, _), n in count.items():
        top[x] = max(n, top.get(x, 0))
    rows = []
    for groups, d in zip(docs, links, strict=True):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append(
            (
                sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), d.total(),
                sum(n for p, n in d.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in d.items()),
                hashlib.sha256(said.encode()).hexdigest() if groups else "",
            )
        )
    return rows


def got(df, n):
    rows = {r.doc_id: tuple(r[c] for c in OUT) for r in df.collect()}
    return [rows[i] for i in range(n)]


def frame(spark, texts):
    rows = [(i, t, "row", 1, "pairs") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, n_best int, pairs string").repartition(3)


def test_odd_texts(spark, libraries):
    out = alignment.align(frame(spark, BATCH_TEXTS))
    assert out.columns == ["doc_id", *OUT]
    assert got(out, len(BATCH_TEXTS)) == plain(BATCH_TEXTS, libraries)


def test_whole_table(spark, root, libraries):
    docs = table(spark, root, "documents")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    ids = sorted(texts)
    rows = {r.doc_id: tuple(r[c] for c in OUT) for r in alignment.align(docs).collect()}
    assert [rows[i] for i in ids] == plain([texts[i] for i in ids], libraries)


@pytest.mark.parametrize("most", [0, 20, 400])
def test_rare_pairs_meet_by_join(spark, libraries, most):
    r = random.Random(5)
    texts = [" ".join(r.choice("river stone naïve Überfluß 12345 東京 foo_bar") for _ in range(r.randint(1, 60))) for _ in range(40)] + [None, "end"]
    assert got(alignment.align(frame(spark, texts), most=most), len(texts)) == plain(texts, libraries)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 6), st.integers(1, 6)), min_size=1, max_size=12), st.integers(0, 1 << 30))
def test_heavy_pieces_hold_each_pair_once(sizes, seed):
    r = np.random.default_rng(seed)
    p, q = (np.array(x) for x in zip(*sizes, strict=True))
    a, b = r.integers(0, 5, p.sum()), r.integers(0, 4, q.sum())
    wide, links = 7, alignment.LINKS
    keys, times = np.unique(alignment._expand(a, p, b, q, wide), return_counts=True)
    try:
        alignment.LINKS = 5
        parts = list(alignment._heavy(a, p, b, q, wide))
    finally:
        alignment.LINKS = links
    assert np.concatenate([k for k, _ in parts]).tolist() == keys.tolist()
    assert np.concatenate([t for _, t in parts]).tolist() == times.tolist()
    k, t = alignment._unpack(alignment._pack(keys, times))
    assert k.tolist() == keys.tolist() and t.tolist() == times.tolist()


def test_heavy_documents_pass_in_several_rows(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "LINKS", 8)
    side_a, side_b = alignment.sides(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["many words that both sides cut in other places: unbelievableness 東京", "short", ""]
    found = alignment.aligned([t.encode() for t in texts], side_a, side_b)
    want = plain(texts, libraries)
    assert [f[:5] for f in found] == [(*w[:4], w[6]) for w in want]
    assert len(found[0][5]) > 1 and len(found[2][5]) == 0
    assert sum(alignment._unpack(b)[1].sum() for b in found[0][5]) == want[0][3]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=40), st.lists(st.integers(1, 7), min_size=1, max_size=40))
def test_pointer_jumping_cuts_at_shared_ends(a, b):
    if sum(a) < sum(b):
        a.append(sum(b) - sum(a))
    elif sum(b) < sum(a):
        b.append(sum(a) - sum(b))
    a_end, b_end = np.cumsum(a), np.cumsum(b)
    shared = np.array(sorted(set(a_end) & set(b_end)))
    stop = alignment.terminals(a_end, b_end)
    assert b_end[stop].tolist() == [shared[np.searchsorted(shared, e)] for e in [*a_end, *b_end]]


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []
