"""Queries that SQL cannot express, held against plain versions over whole tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from turnstone import plans
from turnstone.functions import text as X
from turnstone.functions import udfs as U
from turnstone.operators import retrieval as R


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def chunks(texts):
    """Windows of 20 lines, 4 shared with the next."""
    out = {}
    for i, text in texts.items():
        if text is None:
            continue
        lines = text.split("\n")
        lines = lines[:-1] if lines and lines[-1] == "" else lines
        at = 0
        while at < len(lines):
            end = min(at + 20, len(lines))
            body = "\n".join(lines[at:end])
            if body.strip():
                out[f"{i}:{at + 1}-{end}"] = body
            if end == len(lines):
                break
            at += 16
    return out


def test_personal_data(spark, sf_dir, texts):
    patterns = [(name, re.compile(p.replace("(?U)", "")), token) for name, p, token in X.PII]
    want = {}
    for i, text in texts.items():
        counts = {}
        for name, p, token in patterns:
            text, counts[name] = p.subn(token, text or "")
        want[i] = (counts, hashlib.md5(text.encode()).hexdigest())
    got = plans.QUERIES["pii_full"](spark, sf_dir).collect()
    assert len(got) == len(want) and sum(sum(c.values()) for c, _ in want.values())
    for r in got:
        assert ({k: r[k] or 0 for k in want[r.doc_id][0]}, r.text_md5) == want[r.doc_id]


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_character_errors(spark, sf_dir):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append((r.turn, r.text))
    marks = re.compile(X.PUNCTUATION)
    flat = lambda t: "".join(marks.sub("", t.lower().replace("-", " ")).split())
    got = {(r.conv_id, r.turn): r for r in plans.QUERIES["cer_pairs"](spark, sf_dir).collect()}
    n = 0
    for conv, rows in turns.items():
        for (turn, a), (_, b) in zip(rows, rows[1:]):
            n += 1
            a, b = flat(a), flat(b)
            if len(a) * len(b) > 40_000:
                continue
            want = plain_edits(a, b)
            assert got[conv, turn].char_errors == want and got[conv, turn].cer == pytest.approx(want / len(a) if a else len(b), abs=1e-6)
    assert n == len(got)


def names_in(text):
    """Names by the fixed patterns, in plain regular expressions."""
    stop = set(R.CAPITAL_STOP)
    out = [t.strip() for t in re.findall(R.BACKTICK, text)]
    out = [t for t in out if len(t) >= 2 and " " not in t]
    for phrase in re.findall(R.CAPITALS.replace("(?U)", ""), text):
        words = phrase.split()
        while words and words[0] in stop:
            words.pop(0)
        if len(" ".join(words)) >= 2:
            out.append(" ".join(words))
    for p in (R.SNAKE, R.CAMEL, R.DOTTED):
        out += [m for m in re.findall(p.replace("(?U)", ""), text) if m.lower() not in ("e.g", "i.e", "etc")]
    return set(out)


def test_entities_and_their_graph(spark, sf_dir, chunks):
    want = {}
    for c, text in chunks.items():
        keyed = {}
        for name in sorted(names_in(text)):
            keyed.setdefault("ent:" + " ".join(name.lower().split()), name)
        want[c] = dict(sorted(keyed.items())[: R.MAX_ENTITIES])
    got = defaultdict(dict)
    for r in plans.QUERIES["entities"](spark, sf_dir).collect():
        got[r.chunk_id][r.key] = r.name
    assert {c: set(v) for c, v in want.items() if v} == {c: set(v) for c, v in got.items()}
    found = R.mentions(plans.retrieval.chunks(spark, sf_dir))
    edges = Counter((r.src, r.dst, r.rel, r.chunk_id) for r in R.graph_edges(found).collect())
    plain = {(f"chunk:{c}", k, "mentions"): None for c, v in want.items() for k in v}
    for c, v in want.items():
        keys = sorted(v)
        for i, a in enumerate(keys):
            for b in keys[i + 1 :]:
                held = plain.get((a, b, "cooccurs"))
                plain[a, b, "cooccurs"] = c if held is None else max(held, c)
    assert edges == Counter({(*k, c): 1 for k, c in plain.items()})
    nodes = Counter(r.key for r in R.graph_nodes(plans.retrieval.chunks(spark, sf_dir), found).collect())
    assert nodes == Counter([f"chunk:{c}" for c in chunks] + list({k for v in want.values() for k in v}))


def test_hybrid_retrieval(spark, sf_dir, chunks):
    """Keyword, vector and graph rankings, fused and floored, query by query."""
    asked = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    grams = lambda t: (lambda w: w + [f"{a} {b}" for a, b in zip(w, w[1:])])(re.findall("[a-z0-9_]+", t.lower()))
    stop = set(X.STOPWORDS)
    posts = defaultdict(set)
    for c, t in chunks.items():
        for g in set(grams(t)):
            posts[g].add(c)
    ids = sorted(chunks)
    matrix = U.embed_batch([chunks[c] for c in ids], 512, True)
    length = np.linalg.norm(matrix, axis=1)
    unit = np.divide(matrix, length[:, None], out=np.zeros_like(matrix), where=length[:, None] > 0)
    ents = {c: set(["ent:" + " ".join(n.lower().split()) for n in names_in(t)]) for c, t in chunks.items()}
    ents = {c: set(sorted(v)[: R.MAX_ENTITIES]) for c, v in ents.items()}
    limit = max(1, min(R.MAX_DF, int(len(chunks) * R.MAX_DF_FRACTION)))
    got = defaultdict(list)
    for r in plans.QUERIES["hybrid_retrieve"](spark, sf_dir).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    close = 0
    for q, text in asked.items():
        scores = Counter()
        for g in set(grams(text)):
            if all(w in stop for w in g.split()) or not 0 < len(posts[g]) <= limit:
                continue
            for c in posts[g]:
                scores[c] += (2 if " " in g else 1) * np.log(1 + len(chunks) / len(posts[g]))
        keyword = sorted(scores, key=lambda c: (-round(scores[c], 9), c))[: R.CANDIDATES]
        v = U.embed_batch([text], 512, True)[0]
        cos = dict(zip(ids, np.round(unit @ (v / (np.linalg.norm(v) or 1)), 9)))
        vector = [c for c in sorted(ids, key=lambda c: (-cos[c], c))[: R.CANDIDATES] if cos[c] > 0]
        seeds = set(keyword[: R.TOP_K]) | set(vector[: R.TOP_K])
        keys = {"ent:" + " ".join(n.lower().split()) for n in names_in(text)} | {k for c in seeds for k in ents[c]}
        hits = {c: len(ents[c] & keys) for c in ids if c not in seeds and ents[c] & keys}
        graph = sorted(hits, key=lambda c: (-hits[c], c))[: R.CANDIDATES]
        fused = Counter()
        for w, ranking in ((R.KEYWORD_WEIGHT, keyword), (1.0, vector), (1.0, graph)):
            for i, c in enumerate(ranking, 1):
                fused[c] += w / (R.RRF_K + i)
        order = sorted(fused, key=lambda c: (-round(fused[c], 12), c))
        stays = [c for c in order if c in keyword or cos[c] >= R.MIN_COSINE][: R.TOP_K]
        mine = [r.chunk_id for r in got[q]]
        # Cosines that agree to nine digits may be ordered by the last bits of their sums.
        close += mine == stays
        assert len(mine) == len(stays)
    assert close >= 0.95 * len(asked)


def test_embeddings_are_made_slice_by_slice():
    """However many rows Spark sends at once, few are worked on and sent back at once."""
    import pandas as pd

    texts = [f"word{i} other{i % 7}" for i in range(1000)] + [None, "x " * U.SLICE_CHARS, "last"]
    parts = list(U.hashing_embedder(16).func(iter([pd.Series(texts), pd.Series([], dtype=object)])))
    assert max(map(len, parts)) <= U.SLICE_ROWS and [len(p) for p in parts[-2:]] == [1, 1]
    assert np.array_equal(np.array([e for p in parts for e in p]), U.embed_batch([t or "" for t in texts], 16))


def test_operations_are_made_slice_by_slice():
    import pandas as pd

    ref = [["a", "b", str(i)] for i in range(1000)] + [None]
    hyp = [["a", str(i), "c"] for i in range(1000)] + [["x"]]
    parts = list(U.alignment_ops.func(iter([(pd.Series(ref), pd.Series(hyp))])))
    assert max(map(len, parts)) <= U.SLICE_ROWS
    assert [[tuple(o.values()) for o in ops] for p in parts for ops in p] == [U.alignment(r or [], h) for r, h in zip(ref, hyp)]


def test_grams_are_found_slice_by_slice():
    from types import SimpleNamespace

    import pyarrow as pa

    from turnstone.functions import grams

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([f"a{i} b" for i in range(1000)])], names=["id", "text"])
    parts = list(grams.find_grams(SimpleNamespace(value=frozenset(["a7 b", "a999"])))(iter([batch])))
    assert max(len(set(p.column(0).to_pylist())) for p in parts) <= grams.SLICE_ROWS
    found = [x for p in parts for x in zip(p.column(0).to_pylist(), p.column(1).to_pylist())]
    assert [x for x in found if x[1]] == [(7, "a7 b"), (999, "a999")] and len(found) == 1002


@pytest.mark.parametrize(("piece", "held"), [(1 << 21, 2_000_000), (40, 50), (1, 1)])
def test_grams_are_counted_piece_by_piece(monkeypatch, piece, held):
    """Words are numbered and grams counted as arrays: the counts of a plain version, however texts are cut, and each gram once a task while it fits."""
    import pyarrow as pa

    from turnstone.functions import grams

    monkeypatch.setattr(grams, "PIECE", piece)
    monkeypatch.setattr(grams, "HELD", held)
    rng = random.Random(5)
    texts = [None, "", "İs K9 a_b  a_b"] + ["".join(rng.choice("ab AB_9 -İKé\n") for _ in range(rng.randrange(40))) for _ in range(60)]
    want = Counter({None: len(texts)})
    for t in texts:
        found = re.findall("[a-z0-9_]+", (t or "").lower())
        want.update({*found, *map(" ".join, zip(found, found[1:]))})
    for kind in (pa.string(), pa.large_string()):
        batch = pa.RecordBatch.from_arrays([pa.array(["not read", *texts], kind)], names=["text"]).slice(1)
        parts = list(grams.count_grams(iter([batch.slice(0, 7), batch.slice(7)])))
        rows = [r for p in parts for r in zip(p.column(0).to_pylist(), p.column(1).to_pylist())]
        got = Counter()
        for g, n in rows:
            got[g] += n
        assert got == want and (held < 1000 or len(rows) == len(want))


def test_lines_by_every_break(spark):
    """Texts with the line feed alone and with other breaks are split alike."""
    texts = ["", "\n", "a\nb\n", "a\n\nb", "a\r\nb\rc\n", *[f"x\n{c}y{c}\nz" for c in "\r\x0b\x0c\x1c\x1d\x1e\x85  "], "a\tb\x1fc", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("t", X.lines(F.col("t")).alias("l")).collect()
    assert [r.l for r in rows] == [None if r.t is None else re.split("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", r.t) for r in rows]


def test_grams_are_posted_as_they_are_one_by_one(monkeypatch):
    import pyarrow as pa

    from turnstone.functions import grams

    texts = ["a b a b c", None, "", "B a", "..", "x" * 40 + " a b", "Ka İ c"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array([f"t{i}" for i in range(len(texts))])], names=["text", "id"])
    want = set()
    for i, text in enumerate(texts):
        found = re.findall("[a-z0-9_]+", (text or "").lower())
        want |= {(g, f"t{i}") for g in [*found, *map(" ".join, zip(found, found[1:]))]}
    for size in (1, 20, 1 << 22):
        monkeypatch.setattr(grams, "POSTED", size)
        monkeypatch.setattr(grams, "ROWS", 3)
        got = [(r["gram"], i) for p in grams.post_grams(iter([batch.slice(0, 3), batch.slice(3)])) for r in p.to_pylist() for i in r["ids"]]
        assert len(got) == len(want) and set(got) == want
