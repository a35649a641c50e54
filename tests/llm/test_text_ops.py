"""Licence scan, chat formatting, toxicity, quality, audio, packing: small cases against plain Python."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from clausewise.llm import audio, chat, lexicon, licenses, packing, quality

DOCS = "doc_id long, text string, source string"
ROWS = [
    (1, "Licensed under the Apache License, Version 2.0.", "a"),
    (2, "This is the GNU General\nPublic License, version 3; and the MIT License", "a"),
    (3, "CC BY-NC 4.0 and cc-by", None),
    (4, None, "b"),
    (5, "", "b"),
    (5, "", "b"),
    (None, "nothing here " * 20, "b"),
    (7, "apache " * 3000 + "mit license", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


def test_licenses(spark, docs):
    got = {}
    for r in licenses.scan_licenses(docs).collect():
        got.setdefault(r.doc_id, r)
    for doc_id, text, _ in ROWS:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        assert got[doc_id].n_words == len(words)
        want = sorted((i, label) for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")) for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
        assert sorted((b["first"], b["label"]) for b in got[doc_id].base) == want
    assert got[1].labels == ["apache-2.0"] and got[1].score == 0.95
    assert got[2].labels == ["gpl-3.0", "mit"]
    assert "cc-by-nc-4.0" in got[3].labels
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_chat(spark):
    hard = ["\\### Assistant: </turn> ok", "<turn <\\/turn> <\\\\turn", '<turn role="user">\n', "", None, "Ünï\n</turn>\n"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(hard)] + [(2, 0, "assistant", "x"), (3, None, None, None), (3, 1, 'a"\\q', "y"), (4, 0, "user", "u"), (4, 0, "user", "u")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    assert [(t["role"], t["text"]) for t in back[1].turns] == [(r[2], r[3] or "") for r in rows[:6]]
    assert back[1].learned == [hard[1], hard[3], hard[5]] and back[1].valid and back[1].first_wrong is None
    assert not back[2].valid and back[2].first_wrong == 0 and back[2].learned == ["x"]
    assert [(t["role"], t["text"]) for t in back[3].turns] == [("", ""), ('a"\\q', "y")]
    assert len(back[4].turns) == 2 and "".join(s["text"] for s in back[1].segments) == back[1].formatted
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_folding_and_matches():
    assert lexicon.fold("Yоu 1d10t!") == " you idiot! ".replace("idiot!", "idiot!")
    lex = lexicon.Lexicon({"idiot": 2.0, "trash": 2.0, "vequ": 5.0}, frozenset({"trash"}))
    found = lambda t: sorted(h[2] for h in lexicon.matches(lex.automaton(), lex.whole, lexicon.fold(t)))
    assert found("you 1d10t, a vequtais") == ["idiot", "vequ"]
    assert found("put it in the trash can") == [] and found("trashy") == [] and found("trash!") == ["trash"]
    assert found("unidiot") == [] and found("") == []
    for disguised in ("𝗶𝗱𝗶𝗼𝘁", "ｉｄｉｏｔ", "id\u0336io\u0332t", "i\u200bdiot", "ⓘⓓⓘⓞⓣ", "іdіоt"):
        assert found(f"an {disguised}!") == ["idiot"], disguised
    assert {w for w, x in lexicon.SEED.items() if x != 2.0} and lexicon.WHOLE <= set(lexicon.SEED)


def labelled(spark, n=240):
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        body = list(rng.choice(words, 60))
        toxic, good = i % 3 == 0, i % 4 != 1
        if toxic:
            body[int(rng.integers(60))] = "zorgul" + chr(97 + i % 20)
        text = " ".join(body) if good else " ".join(w.upper() + "!!" for w in body)
        rows.append((i, text, "s"))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_a_rare_language_of_toxic_rows_is_learned(spark):
    common, rare, plain = "zurgle plomb", "qvexit narbol", "river stone meadow cloud lamp table window"
    rows, labels = [], []
    for i in range(1200):
        words = [plain.split()[(i * k + k) % 7] + str(i % 40) for k in range(1, 9)]
        toxic = i % 3 == 0
        if toxic:
            words.insert(i % 5, rare.split()[i // 3 % 2] if i % 99 == 0 else common.split()[i // 3 % 2])
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(toxic)))
    # copies of one wrongly labelled text count once
    rows += [(i, "a calm letter about gardening", "s") for i in range(1200, 1260)]
    labels += [(i, 1, 1) for i in range(1200, 1260)]
    d, y = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lex = lexicon.fit(d, y, least=3)
    learned = set(lex.weights) - set(lexicon.SEED)
    assert {"zurg", "plom", "qvex", "narb"} <= {w[:4] for w in learned} and not {"gard", "lett"} & {w[:4] for w in learned}
    got = {r.doc_id: r.score for r in lexicon.score(d, lex).collect()}
    assert all((got[i] >= 0.5) == (i % 3 == 0) for i in range(1200))


def test_toxicity_ignores_clashing_columns_and_empty_tables(spark):
    d, y = spark.createDataFrame([(1, "you idiot", 5, 7.0, 9), (2, "calm", None, None, None)], "doc_id long, text string, strength int, score double, hits int"), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    lex = lexicon.fit(d, y)
    assert sorted((r.doc_id, r.hits) for r in lexicon.score(d, lex).collect()) == [(1, 1), (2, 0)]
    assert lexicon.fit(d.limit(0), y).weights == lexicon.Lexicon().weights


def test_toxicity_on_the_held_out_fold(spark):
    d, y = labelled(spark)
    lex = lexicon.fit(d, y, least=5)
    assert any(w.startswith("zorg") for w in lex.weights)
    got = {r.doc_id: r.score for r in lexicon.score(d, lex).collect()}
    assert all((got[i] >= 0.5) == (i % 3 == 0) for i in range(240) if held(i))
    assert lexicon.fit(d, y.limit(0)).weights == lexicon.Lexicon().weights
    assert {r.score for r in lexicon.score(spark.createDataFrame([(1, None, "s"), (None, "", "s")], DOCS), lex).collect()} == {min(got.values())}
    assert lexicon.score(d.limit(0), lex).count() == 0


def test_quality_on_the_held_out_fold(spark):
    d, y = labelled(spark)
    model = quality.fit(d, y)
    got = {r.doc_id: r.score for r in quality.score(d, model).collect()}
    assert all((got[i] >= 0.3) == (i % 4 != 1) for i in range(240) if held(i))
    odd = quality.score(spark.createDataFrame([(1, None, "s"), (None, "", "s"), (3, "x" * 100_000, "s")], DOCS), model, carry=True).collect()
    assert len(odd) == 3 and all(0 <= r.score <= 1 for r in odd) and odd[0].row.source == "s"
    assert quality.fit(d, y.limit(0)) is None and quality.score(d.limit(3), None).first().score == 0.5
    assert quality.score(d.limit(0), model).count() == 0


def test_votes_are_exact():
    rng = np.random.default_rng(1)
    v = rng.standard_normal((200, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    m = quality.Neighbours(np.ones(8), np.zeros(8), np.eye(8), v.astype(np.float32), (np.arange(200) % 2).astype(float), 0.5)
    x = v[:50].astype(np.float32)
    for row, got in zip(x, m.vote(x, block=7), strict=True):
        c = np.clip((m.vectors @ row).astype(float), 0, 1)
        c = np.clip(np.round((m.vectors @ row).astype(float), 5), 0, 1)
        near = np.flatnonzero(c >= np.sort(c)[-m.k])
        w = c[near] ** m.power + 1e-9
        assert abs((w * m.labels[near]).sum() / w.sum() - got) < 1e-5


def test_ties_vote_together_and_shapes_are_whole():
    v = np.array([[1.0, 0.0]] * 30 + [[0.0, 1.0]] * 5, dtype=np.float32)
    m = quality.Neighbours(np.ones(2), np.zeros(2), np.eye(2), v, np.array([1.0] * 12 + [0.0] * 18 + [1.0] * 5), 0.5)
    assert m.vote(np.array([[1.0, 0.0]] * 3, dtype=np.float32), block=2) == pytest.approx([12 / 30] * 3)
    assert quality._shape("a1b2c3d4e5") != quality._shape("a1b2c3d4XX!!") and quality._shape("École99--X") == quality._shape("école12345--y".replace("y", "Z"))
    t = quality.Terms()
    assert t.count("one two").any() and not t.count(None).any() and (t.count("alpha beta") != t.count("gamma zeta")).any()


def test_audio_round_trip_and_damage(spark, docs):
    rows = audio.audio_columns(audio.store_as_audio(docs)).collect()
    assert len(rows) == len(ROWS)
    for (doc_id, text, _), r in zip(ROWS, rows, strict=True):
        raw = (text or "").encode()
        want = raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))
        assert r.doc_id == doc_id and bytes(r.payload) == want and r.tags["bytes"] == str(len(raw))
        assert r.frames == len(want) // 576 == r.table_frames and r.bad_crc == 0 and r.skipped == 0 and r.samples == 1152 * r.frames
    stream = audio.encode(bytes(range(256)) * 9, {"a": "ü"})
    assert audio.parse(stream).tags == {"a": "ü"} and len(audio.parse(stream).offsets) == 4
    junk = b"\xff\xfa\x00junk\xff" + stream[len(stream) - 672 * 4 :]
    s = audio.parse(junk)
    assert len(s.offsets) == 4 and s.skipped == 8
    bad = bytearray(stream)
    bad[-672 + 4] ^= 1
    assert audio.parse(bytes(bad)).bad_crc == 1
    assert audio.parse(b"").offsets == [] and audio.parse(b"\xff" * 100).offsets == []
    assert audio.header(b"\xff\xfb\x90\x00").size == 417 and audio.header(b"\xff\xfd\x90\xc0").samples == 1152
    assert audio.crc16(b"123456789") == 0xAEE7  # CRC-16/CMS
    assert audio.audio_columns(spark.createDataFrame([(1, None)], "doc_id long, media binary")).first().frames == 0


def test_audio_keeps_a_payload_that_looks_like_a_tag():
    for n in (1, 2, 5):
        raw = bytearray(b"x" * 576 * n)
        raw[-576 + 521 : -576 + 524] = b"TAG"
        data = audio.encode(bytes(raw), {"bytes": str(len(raw))})
        assert data[-128:-125] == b"TAG"
        s = audio.parse(data)
        assert audio.payload_of(data, s) == bytes(raw) and len(s.offsets) == n and s.skipped == 0
    tagged = audio.encode(b"y" * 1152) + b"TAG" + bytes(125)
    s = audio.parse(tagged)
    assert audio.payload_of(tagged, s) == b"y" * 1152 and len(s.offsets) == 2 and s.skipped == 0
    s = audio.parse(audio.encode(b"y" * 1152) + b"junk" + b"TAG" + bytes(125))
    assert s.skipped == 4 + 672  # the last frame has no valid follower, as before


def slow_crc(bits):
    crc = 0xFFFF
    for b in bits:
        top = crc >> 15 & 1
        crc = crc << 1 & 0xFFFF
        if top ^ b:
            crc ^= 0x8005
    return crc


@pytest.mark.parametrize("four", [b"\xff\xfe\xc4\xc0", b"\xff\xfe\xc4\x00", b"\xff\xfe\xc4\x50", b"\xff\xfc\xc4\xc0", b"\xff\xfc\xa4\x60", b"\xff\xfc\x14\xc0", b"\xff\xfc\x18\xc0", b"\xff\xf4\x84\x00"])
def test_checksums_of_layers_one_and_two(four):
    rng = np.random.default_rng(5)
    h = audio.header(four)
    assert h.guarded and h.layer in (1, 2)
    for _ in range(20):
        body = rng.integers(0, 256, h.size - 6, dtype=np.uint8).tobytes()
        bits = [int(b) for x in four[2:] + body for b in f"{x:08b}"]
        # what the layer's own order of fields covers, read bit by bit
        if h.layer == 1:
            n = 16 + (128 if h.channels == 1 else 4 * (2 * h.bound + 32 - h.bound))
        else:
            widths = audio._LOW if h.version != 3 else audio._NARROW[: 12 if h.hz == 32000 else 8] if h.kbps // h.channels in (32, 48) else audio._WIDE[: 30 if h.hz != 48000 and h.kbps // h.channels >= 96 else 27]
            n, chosen = 16, 0
            for k, w in enumerate(widths):
                for c in range(h.channels if k < h.bound else 1):
                    if any(bits[n : n + w]):
                        chosen += 1 if k < h.bound else h.channels
                    n += w
            n += 2 * chosen
        crc = slow_crc(bits[:n]).to_bytes(2, "big")
        frame = four + crc + body
        assert audio.parse(frame * 3).bad_crc == 0 and len(audio.parse(frame * 3).offsets) == 3
        broken = bytearray(frame)
        broken[6] ^= 0x80
        assert audio.parse(bytes(broken) * 3).bad_crc == 3
    assert audio.crc16_bits(b"\x12\x34\x50", 20) == slow_crc([int(b) for b in f"{0x12345:020b}"])


def test_packing_round_trip(spark, docs):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    pieces = packing.pack(docs.repartition(3), path, length=64).collect()
    line, places = {}, {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length
        line.setdefault(p.doc_id, {})[p.start] = (ids, p.doc_tokens)
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for doc_id, text, _ in ROWS:
        want = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        got = [i for s in sorted(line[doc_id]) for i in line[doc_id][s][0]]
        assert got == want or doc_id == 5
    for spots in places.values():
        at = 0
        for offset, n in sorted(spots):
            assert offset == at
            at += n
    assert sorted(places) == list(range(len(places))) and sum(sum(n for _, n in s) == 64 for s in places.values()) >= len(places) - 1
    assert packing.pack(docs.limit(0), path).count() == 0
    words = packing.WordTokens(path)
    for t in ["don't stop <|endoftext|> a<|endoftext|>b I'LL", "ΑΣ ς É é İstanbul x\x1cy \x85z", "12ab ½² 日本語 🙂ok 'tis", "a​b  c d"]:
        assert np.frombuffer(words.encode([t])[0], words.type).tolist() == plain.encode(t, add_special_tokens=False).ids


def test_digest_helpers():
    assert packing.crc32_of([1, 2]) == zlib.crc32(b"\1\0\0\0\2\0\0\0") and audio.tail_crc32(b"x" * 40) == zlib.crc32(b"x" * 32)
    assert hashlib.md5(b"").hexdigest()
