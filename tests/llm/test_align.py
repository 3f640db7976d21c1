"""Cross-tokenizer alignment against a plain version with the tokenizers' own libraries."""

import hashlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from turnstone.llm import align as A


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A.BYTE_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=A.PIECE_BPE)


def plain_bytes(tokenizers, text):
    """(id, bytes) of either side's tokens, empty where the bytes aren't those of space+text."""
    a, b = tokenizers
    if not text:
        return [], []
    letters = {}
    free = 256
    for x in range(256):
        if chr(x).isprintable() and not chr(x).isspace() and x != 173:
            letters[chr(x)] = x
        else:
            letters[chr(free)] = x
            free += 1
    left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (left, right) if all(b"".join(x for _, x in side) == want for side in (left, right)) else ([], [])


def plain_align(tokenizers, rows):
    held, linked = [], defaultdict(set)
    for n, (doc_id, text) in enumerate(rows):
        left, right = plain_bytes(tokenizers, text)
        spans = []
        for side in (left, right):
            at, out = 0, []
            for i, x in side:
                out.append((at, at + len(x), i))
                at += len(x)
            spans.append(out)
        links, j0 = [], 0
        for s, e, i in spans[0]:
            while j0 < len(spans[1]) and spans[1][j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(spans[1]) and spans[1][j][0] < e:
                links.append((i, spans[1][j][2]))
                j += 1
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, s = [], 0
        for e in cuts:
            groups.append("|".join(",".join(str(i) for x, y, i in side if s <= x and y <= e) for side in spans))
            s = e
        for x in set(links):
            linked[x].add(n)
        held.append((doc_id, spans, links, groups))
    count = {k: len(v) for k, v in linked.items()}
    best = Counter()
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    out = []
    for doc_id, spans, links, groups in held:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc_id, len(spans[0]), len(spans[1]), len(groups), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), digest))
    return out


ODD = [
    (1, "Plain words, twice."), (1, "Plain words, twice."), (2, None), (3, ""), (4, " "), (5, "  lead and  trail  \n\n"), (None, "no id"), (None, None), (6, "▁ real mark"), (7, "<|endoftext|> <s> </s> <0x41>"),
    (8, "naïve café, 日本語テキスト 🙂🙂 ­ 　x"), (9, "\r\n\t\u0000\u0001"), (10, "x" * 30_000), (11, " " * 5_000), (12, "word " * 20_000),
]


def rows_of(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


@pytest.mark.parametrize("limit", [A.BROADCAST_PAIRS, 0])
def test_odd_texts_against_plain_version(spark, tokenizers, limit):
    docs = spark.createDataFrame([(i, t, 7, b"x") for i, t in ODD], "doc_id long, text string, n_a int, pairs binary").repartition(3)
    assert rows_of(A.align(docs, broadcast_pairs=limit)) == Counter(plain_align(tokenizers, ODD))


def test_documents_against_plain_version(spark, sf_dir, tokenizers):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(A.op11_align(spark, sf_dir)) == Counter(plain_align(tokenizers, rows))


def test_chunks_ask_for_their_own_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert rows_of(A.align(docs, broadcast_pairs=0)) == rows_of(A.align(docs))


def test_groups_cover_each_text(spark, tokenizers):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").where("doc_id > 3")
    groups = defaultdict(list)
    for r in A.token_groups(docs).collect():
        groups[r.doc_id].append((r.group, r.start, r.end, r.a, r.b))
    for doc_id, text in ODD:
        left, right = plain_bytes(tokenizers, text)
        if doc_id is None or doc_id <= 3:
            continue
        got = sorted(groups[doc_id])
        assert [x for g in got for x in g[3]] == [i for i, _ in left] and [x for g in got for x in g[4]] == [i for i, _ in right]
        assert [g[0] for g in got] == list(range(len(got))) and [g[1] for g in got] == [0, *[g[2] for g in got]][: len(got)]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert A.align(none).count() == 0 and A.align(none, broadcast_pairs=-1).count() == 0 and A.token_groups(none).count() == 0


def test_both_ways_of_merging_agree(tokenizers):
    import json

    with open(A.BYTE_BPE, "rb") as f:
        content = f.read()
    quick = A.ByteLevel(content)
    spec = json.loads(content)
    spec["pre_tokenizer"]["trim_offsets"] = False  # not the form that ranks are used for
    own = A.ByteLevel(json.dumps(spec).encode())
    texts = [t for _, t in ODD if t]
    assert quick._rank is not None and own._rank is None and quick.encode(texts) == own.encode(texts)
