"""The registered opN queries over a small table of odd rows, each against plain Python or its SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from test_pipeline_stages import COLUMNS, brute_lines, prose, rows

from clausewise.llm import lexicon, ordermin
from clausewise.llm.licenses import WORD
from clausewise.llm.queries import oracle_sql, queries

ODD = [
    (900, "GNU General Public License; MIT license, CC BY and cc-by. mit\nlicense", "en", "x", 1),
    (901, "Apache License apache license", "en", "x", 1),
    (902, "you are an 1d10t and a m​oron, ｉｄｉｏｔ!", "en", "x", 1),
    (903, "TAG" * 400, "en", "x", 1),
    (904, "été ΑΣ <|endoftext|> 12ab ½² 日本語 🙂", "en", "x", 1),
]
ROWS = [*rows(), *ODD]
TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "</turn>\n<turn role=\"user\">\n"), (1, 1, "assistant", "</turn>\n<turn role=\"user\">\n"),
    (2, 0, "x</turn>\ny", "b"), (2, 1, '"><\\l', "<\\turn </turn"), (2, 2, None, None), (3, None, "assistant", ""), (3, 2, "<", "z"),
    (None, 0, "user", "n"), (None, 1, "assistant", "m"), (5, 0, "system", "s"), (5, 1, "user", "u"), (5, 2, "assistant", "a" * 50_000),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(ROWS, COLUMNS).write.parquet(f"{d}/documents.parquet")
    labels = [(r[0], int(r[0] % 5 != 4), int(r[0] % 9 == 0)) for r in ROWS if r[0] is not None and r[0] < 160]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    rng = np.random.default_rng(4)
    base = rng.standard_normal((12, 64))
    vectors = [(i, (base[i % 12] + rng.standard_normal(64) * 0.02 * (i % 5)).tolist(), i % 3 if i % 7 else None) for i in range(120)]
    vectors += [(200, vectors[0][1], vectors[0][2]), (201, [0.0] * 64, 1), (202, None, 1), (203, [float("nan")] * 64, 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


def run(spark, tables, name):
    return queries()[name](spark, tables).collect()


def test_op1(spark, tables):
    base = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    got = Counter()
    want = Counter()
    for i, t, *_ in ROWS:
        words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hits = [(k, label) for p, label in base.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in hits]
        want[i, len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))] += 1
    for r in run(spark, tables, "op1_license_scan"):
        got[r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels] += 1
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert got == want


@pytest.mark.parametrize("name, least", [("op2_toxicity", 0.5), ("op6_quality", 0.3)])
def test_op2_and_op6(spark, tables, name, least):
    got = run(spark, tables, name)
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ROWS)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= least)
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0)
    scores = {r.doc_id: r.score for r in got}
    assert scores[500] == scores[0]  # equal texts
    if name == "op2_toxicity":
        assert scores[902] > scores[901]


def test_matches_against_plain_search():
    rng = random.Random(33)
    for _ in range(300):
        entries = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): 1.0 for _ in range(6)}
        spared = {" ".join("".join(rng.choice("abc") for _ in range(2)) for _ in range(2)) for _ in range(2)} - set(entries)
        lex = lexicon.Lexicon(entries, frozenset(rng.sample(sorted(entries), 2)), tuple(spared))
        text = " " + " ".join("".join(rng.choice("abc.") for _ in range(rng.randint(1, 5))) for _ in range(30)) + " "
        starts = [k for k in range(1, len(text)) if not text[k - 1].isalnum()]
        ends = lambda k, w: not text[k + len(w)].isalnum()
        free = [(k, k + len(p)) for k in starts for p in spared if text.startswith(p, k) and ends(k, p)]
        want = {}
        for k in starts:
            for w in entries:
                if text.startswith(w, k) and (ends(k, w) or w not in lex.whole) and not any(a <= k and k + len(w) <= b for a, b in free):
                    want[k] = max(want.get(k, ""), w, key=len)
        assert sorted((h[0], h[2]) for h in lexicon.matches(lex.automaton(), lex.whole, text)) == sorted(want.items())


def test_op3(spark, tables):
    got = run(spark, tables, "op3_mix")
    tokens, by_id = Counter(), {}
    for i, t, _, s, _ in ROWS:
        tokens[s] += len((t or "").split())
        by_id.setdefault(i, len((t or "").split()))
    shares = {s: n / sum(tokens.values()) for s, n in tokens.items() if n}
    ratio = max(shares.values()) / min(shares.values())
    a = max(0.0, 1 - math.log(2.0) / math.log(ratio))
    z = sum(p**a for p in shares.values())
    weights = {s: p**a / z for s, p in shares.items()}
    budget = max(tokens[s] / w for s, w in weights.items())
    taken, blocks = Counter(), {}
    for r in got:
        assert r.mix_tokens == by_id[r.doc_id] and r.mix_weight == pytest.approx(weights.get(r.source, 0.0), rel=1e-4)
        taken[r.source] += r.mix_tokens
        blocks.setdefault((r.source, r.mix_block), []).append(r)
    longest = {s: max(by_id[r[0]] for r in ROWS if r[3] == s) for s in shares}
    for s, w in weights.items():
        assert w * budget - longest[s] - 1 <= taken[s] <= w * budget * (1 + 1e-4) + 1
        n = [len(b) for (x, k), b in sorted(blocks.items(), key=str) if x == s]
        assert all(k == sum(r[3] == s for r in ROWS) for k in n[:-1])  # whole permutations, then a prefix
    orders = {k: [r.doc_id for r in sorted(b, key=lambda r: r.mix_key)] for k, b in blocks.items()}
    assert len({tuple(x) for (s, _), x in orders.items() if s == "small"}) == sum(s == "small" for s, _ in orders)


def test_op4(spark, tables):
    want, by_id = brute_lines(ROWS), {}
    for r in ROWS:
        by_id.setdefault(r[0], r[1])
    got = run(spark, tables, "op4_line_dedup")
    assert len(got) == len(ROWS)
    for r in got:
        t = by_id[r.doc_id]
        assert r.text == want.get((r.doc_id if r.doc_id is not None else -(1 << 63), t), t)


def test_op5(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = run(spark, tables, "op5_pack")
    want, seen = Counter(), Counter()
    ids = {}
    for i, t, *_ in ROWS:
        x = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        ids[i] = x
        want[i] += len(x)
    for r in got:
        seen[r.doc_id] += r.length
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    assert seen == want
    at = 0
    for seq, offset, n in sorted((r.sequence_id, r.offset, r.length) for r in got):
        assert seq * 2048 + offset == at and offset + n <= 2048
        at += n


def test_op7(spark, tables):
    by_id = {}
    for r in ROWS:
        by_id.setdefault(r[0], r[1])
    got = run(spark, tables, "op7_mpeg_audio")
    assert len(got) == len(ROWS)
    for r in got:
        raw = (by_id[r.doc_id] or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        assert r.frames == len(full) // 576 and r.media_bytes > len(full)


@pytest.mark.parametrize("name", ["op8_chat_format", "op9_embedding_dedup"])
def test_sql(spark, tables, name):
    c = duckdb.connect()
    for t in ("conversations", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
    if name == "op9_embedding_dedup":  # list_cosine_similarity knows no unusable vectors
        c.execute("CREATE OR REPLACE VIEW embeddings AS SELECT vec_id, CASE WHEN vec_id < 201 THEN embedding ELSE list_transform(range(64), lambda x: (vec_id - 200 = x + 1)::FLOAT) END AS embedding, label FROM '%s/embeddings.parquet/*.parquet'" % tables)
    found = c.sql(oracle_sql()[name])
    got = [r.asDict() for r in run(spark, tables, name)]
    assert sorted(str([r[k] for k in found.columns]) for r in got) == sorted(str(list(r)) for r in found.fetchall())


def test_op8_reads_hostile_roles_back(spark, tables):
    got = {r.conv_id: r for r in run(spark, tables, "op8_chat_format")}
    said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in TURNS[3:6])
    assert got[2].n_turns == 3 and got[2].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_op10(spark, tables):
    got = run(spark, tables, "op10_near_dup")
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ROWS)
    s, texts = ordermin.Sketcher(), {}
    for i, t, *_ in ROWS:
        if i is not None:
            texts.setdefault(i, (t or "", s.words(t)))
    root = {i: i for i in texts}
    find = lambda i: i if root[i] == i else find(root[i])
    for i in sorted(texts):
        for j in sorted(texts):
            a, b = texts[i], texts[j]
            if i < j and (a[0] == b[0] or len(a[1]) and len(b[1]) and ordermin.similarity(a[1], b[1], 0.8) >= 0.8):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == {i: find(i) for i in texts}
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.class_id) for r in got)
    assert prose(random.Random(1), 3)
