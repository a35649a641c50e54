import pytest
from pyspark.sql import functions as F

from clausewise.functions import routing, text
from clausewise.operators import catalog, cite, evaluate, index, rank
from clausewise.plans import ask
from clausewise.plans.llm import Echo

CHUNKS = "id string, pos long, text string, regulation string, article_number string, article_title string, document_label string, doc_type string, language string, chunk_index int, total_chunks int"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        ("D1", 0, "DORA, Article 5 — Governance: the management body defines ict risk arrangements", "DORA", "5", "Governance", "", "statute", "en", 0, 1),
        ("D2", 1, "DORA, Article 17 — Incidents: entities record ict incidents and report them", "DORA", "17", "Incidents", "", "statute", "en", 0, 1),
        ("D3", 2, "DORA, Article 26 — Testing: TLPT at least every 3 years", "DORA", "26", "Testing", "", "statute", "en", 0, 1),
        ("G1", 3, "GDPR, Article 33 — Breach: notify the authority of a breach within 72 hours", "GDPR", "33", "Breach", "", "statute", "en", 0, 1),
        ("G2", 4, "GDPR, Article 17 — Erasure: the right to erasure of personal data", "GDPR", "17", "Erasure", "", "statute", "en", 0, 1),
        ("K1", 5, "KVKK, Article 12 — Güvenlik: veri sorumlusu veri güvenliği tedbirleri alır", "KVKK", "12", "Güvenlik", "", "statute", "tr", 0, 1),
        ("K2", 6, "KVKK, Kurul Kararı 2019/10: ihlal bildirim süresi 72 saat", "KVKK", "", "", "Kurul Kararı 2019/10", "board_decision", "tr", 0, 1),
    ]
    return spark.createDataFrame(rows, CHUNKS)


@pytest.mark.parametrize(
    "question, required, single",
    [
        ("What does DORA Article 5 say?", "DORA", "DORA"),
        ("GDPR and KVKK on breaches", "GDPR,KVKK", None),
        ("a payments startup in Istanbul", "KVKK", None),
        ("our credit institution", "DORA", None),
        ("TÜRKİYE'de kurulu bir banka", "DORA,KVKK", None),
        ("veri ihlali bildirimi ne zaman yapilir, kanun", "KVKK", None),
        ("breach notification", "", None),
    ],
)
def test_routing(spark, question, required, single):
    row = spark.createDataFrame([(question,)], "q string").select(F.array_join(routing.required_regulations(F.col("q")), ",").alias("r"), routing.single_regulation(F.col("q")).alias("s")).first()
    assert (row.r, row.s) == (required, single)


@pytest.mark.parametrize("q, n", [("müşteriler AB’deki verileri", 1), ("customers in the EU", 1), ("neutral", 0)])
def test_eu_cue(spark, q, n):
    row = spark.createDataFrame([(q,)], "q string").select(F.size(F.filter(routing.required_regulations_extended(F.col("q")), lambda r: r == "GDPR")).alias("n")).first()
    assert row.n == n


def one(spark, question, f):
    return spark.createDataFrame([(question,)], "q string").select(f(F.col("q")).alias("x")).first().x


def test_clauses(spark):
    said = lambda q: one(spark, q, ask.clauses)
    assert said("How often do we run X, and how long does Y last?") == ["How often do we run X", "how long does Y last?"]
    assert said("How often do we run X and how often Y?") == []
    assert said("testler ne sıklıkta yapılır ve aktif test aşaması ne kadar sürer") == ["testler ne sıklıkta yapılır", "aktif test aşaması ne kadar sürer"]
    assert said("How often is it run how long is it kept") == ["How often", "is it run how long is it kept"]
    assert said("") == [] and said("no such words, and none here") == []


def test_transfer(spark):
    said = lambda q: one(spark, q, ask.transfer)
    near = "İstanbul'daki şirketimiz hastaların bütün kayıtlarını yıllardır kendi sunucularında düzenli olarak ve güvenle saklıyor. " + "Şimdi verileri Frankfurt'a gönderiyoruz."
    assert tuple(said(near)) == ("KVKK", "GDPR")
    assert said("a bank in Ankara and one in Berlin") is None and said("") is None
    assert said("We send it from Berlin to Ankara") is None  # both are near


def test_places(spark):
    assert [tuple(x) for x in one(spark, "a1b22", lambda c: text.places(c, r"\d+"))] == [(1, 2), (3, 5)] and one(spark, "", lambda c: text.places(c, "x")) == []
    assert one(spark, "a1b22c", lambda c: text.replace_each(c, r"\d+", lambda h: F.when(h == "1", "<x>"))) == "a<x>bc"


def test_functions(spark):
    row = spark.createDataFrame([("İlgili KİŞİ's veri_1", "| a |  | b |\n|---|---|\nx", "ok 合规 审 fine", "What about DORA under GDPR")], "a string, b string, c string, d string").select(
        text.tokenize(F.col("a")).alias("a"), text.fill_blank_cells(F.col("b")).alias("b"), text.strip_unexpected_script(F.col("c")).alias("c"), routing.strip_regulation_names(F.col("d")).alias("d"),
        text.requested_articles(F.lit("art. 5 and madde 7, also 12. madde")).alias("n"), text.strip_thinking(F.lit(None).cast("string"), "none").alias("t"),
    ).first()
    assert row.a == ["ilgili", "kişi", "s", "veri_1"]
    assert row.b == "| a | — | b |\n|---|---|\nx"
    assert row.c == "ok fine" and row.d == "What about" and set(row.n) == {"5", "7", "12"} and row.t == "none"


def ids(df, q=1):
    return [r.id for r in df.where(F.col("query_id") == q).orderBy("rank").collect()]


def test_search_filters_floors_and_reserved_hits(spark, chunks):
    q = spark.createDataFrame([(1, "ict incidents"), (2, "what does article 17 say"), (3, "does 2019/10 still apply")], "query_id int, query string")
    assert ids(rank.bm25(q, chunks, 5))[0] == "D2"
    assert set(ids(rank.bm25(q, chunks, 5, regulations="GDPR"), 2)) <= {"G1", "G2"}
    found = rank.hybrid_search(q, chunks, top_k=2, regulation="DORA")
    assert ids(found, 2)[0] == "D2" and len(ids(found, 2)) <= 3
    assert ids(rank.hybrid_search(q, chunks, top_k=2), 3)[0] == "K2"
    assert rank.bm25(q, chunks.limit(0), 5).count() == 0


def test_cap(spark):
    rows = [(1, i + 1, f"c{i}", 10.0 - i, "R", a, d) for i, (a, d) in enumerate([("1", ""), ("1", ""), ("1", ""), ("1", ""), ("2", "L"), ("3", "L"), ("4", "L"), ("5", "")])]
    ranked = spark.createDataFrame(rows, "query_id int, rank int, id string, score double, regulation string, article_number string, document_label string")
    assert ids(rank.diversity_cap(ranked, 6)) == ["c0", "c1", "c2", "c4", "c5", "c7"]
    assert ids(rank.diversity_cap(ranked, 8)) == ["c0", "c1", "c2", "c4", "c5", "c7", "c3", "c6"]


def test_fusion_and_union(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "query_id int, rank int, id string")
    b = spark.createDataFrame([(1, 1, "y"), (1, 2, "z")], "query_id int, rank int, id string")
    assert ids(rank.fuse([a, b])) == ["y", "x", "z"]
    both = a.withColumn("branch_no", F.lit(0)).unionByName(b.withColumn("branch_no", F.lit(1)))
    once = rank.union_first_wins(both)
    assert ids(once) == ["x", "y", "z"] and ids(rank.union_first_wins(once)) == ["x", "y", "z"]


def test_index_changes(spark, chunks):
    new = chunks.where("id = 'G1'").withColumn("text", F.lit("new")).unionByName(chunks.where("id = 'G2'").withColumn("id", F.lit("G9")))
    merged = {r.id: r for r in index.upsert(chunks, new).collect()}
    assert merged["G1"].text == "new" and merged["G1"].pos == 3 and merged["G9"].pos > 6 and len(merged) == 8
    assert {r.id for r in index.delete_statute(chunks, "KVKK").collect()} == {"D1", "D2", "D3", "G1", "G2", "K2"}
    assert index.delete_document(chunks, "KVKK", "Kurul Kararı 2019/10").where("id = 'K2'").isEmpty()


def test_catalog(spark, chunks):
    notes = {r.regulation: r.note for r in catalog.scope_note(chunks).collect()}
    assert "DORA statute is indexed from Article 5 to Article 26; no Board" in notes["DORA"] and "board decision" in notes["KVKK"]
    q = spark.createDataFrame([(1, "DORA article 72?"), (2, "DORA madde 99"), (3, "DORA article 17"), (4, "DORA 2022/55 article 72"), (5, "article 500")], "query_id int, query string")
    said = {r.query_id: r.answer for r in catalog.out_of_range(q, chunks).collect()}
    assert set(said) == {1, 2} and said[1].startswith("DORA Article 72 does not exist") and "mevcut değil" in said[2]


def test_shapes_and_answers(spark, chunks):
    q = spark.createDataFrame(
        [(1, "ict incidents and entities", "DORA", None), (2, "GDPR and DORA: the authority, breach and ict incidents", None, None), (3, "Under DORA how often is testing done, and how long are incidents kept?", None, None), (4, "DORA article 99", None, None),
         (5, "x" * 401, "DORA", ["ict risk arrangements", "report incidents"])],
        "query_id int, query string, regulation string, sub_questions array<string>",
    )
    shape = {r.query_id: (r.shape, len(r.branches)) for r in ask.shapes(q).collect()}
    assert shape == {1: ("single", 1), 2: ("several", 2), 3: ("compound", 2), 4: ("single", 1), 5: ("scenario", 2)}
    said = {r.query_id: r for r in ask.ask(q, chunks, llm=Echo()).collect()}
    assert said[4].answer.startswith("DORA Article 99 does not exist") and said[4].indices == []
    assert "Article 17" in said[1].answer and "GDPR, Article" in said[2].answer and "DORA, Article" in said[2].answer
    pairs = spark.createDataFrame([(1, "breach reports", "GDPR", "DORA"), (2, "x", "DORA", "DORA")], "query_id int, query string, reg_a string, reg_b string")
    both = {r.query_id: r for r in ask.compare(pairs, chunks).collect()}
    assert "selected on both sides" in both[2].answer and "Sources for GDPR" in both[1].answer


def test_citations(spark):
    results = spark.createDataFrame([(1, 1, "a", "entities record incidents promptly", "DORA", "17", "statute", "en"), (1, 2, "b", "unrelated words entirely", "DORA", "18", "statute", "en"), (1, 3, "c", "veri güvenliği", "KVKK", "12", "statute", "tr")], "query_id int, rank int, id string, text string, regulation string, article_number string, doc_type string, language string")
    answer = "Entities record incidents [1]. Completely different claim sentence [2]. English claim about Turkish law [3]. Nothing [9]. See GDPR Article 6 and DORA Article 17.\n| DORA | [9] |"
    row = cite.verify(spark.createDataFrame([(1, answer)], "query_id int, answer string"), results).first()
    assert row.indices == [1, 3] and "[2]" not in row.answer and "[9]" not in row.answer
    assert "GDPR (article number not confirmed in the sources)" in row.answer and "DORA Article 17" in row.answer and row.answer.endswith("| DORA | — |")
    answers = spark.createDataFrame([(1, answer)], "query_id int, answer string")
    assert {r["rank"] for r in cite.cited(answers, results).collect()} == {1, 3}
    assert [(r.regulation, r.article_number) for r in cite.unverified_mentions(answers, results).collect()] == [("GDPR", "6")]


def test_grading(spark):
    cases = spark.createDataFrame(
        [(1, ["DORA"], [("DORA", "5")], ["bad"], None, None, None), (2, ["NIS2"], None, None, None, None, None), (3, ["DORA"], None, None, "ok", None, ["DORA"]), (4, ["DORA"], None, None, None, None, None)],
        "query_id int, needed array<string>, must array<struct<regulation:string,article:string>>, forbid array<string>, require string, no_citation boolean, only array<string>",
    )
    results = spark.createDataFrame([(1, "DORA", "6")], "query_id int, regulation string, article_number string")
    answers = spark.createDataFrame([(1, "so bad", ["DORA"]), (3, "ok", ["DORA"]), (4, "x", [])], "query_id int, answer string, cited array<string>")
    graded = {r.query_id: (r.status, len(r.reasons)) for r in evaluate.grade(cases, results, answers, spark.createDataFrame([("DORA",)], "regulation string")).collect()}
    assert graded == {1: ("FAIL", 2), 2: ("SKIP", 0), 3: ("PASS", 0), 4: ("SKIP", 0)}
    runs = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (2, 1, "a"), (2, 2, "b"), (3, 1, None), (3, 2, "a")], "query_id int, run int, source string")
    assert {r.query_id: r.diverged for r in evaluate.stability(runs).collect()} == {1: False, 2: True, 3: True}


class Scripted:
    def __init__(self, answers):
        self.answers = list(answers)

    def chat(self, system, user, reasoning=False):
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer


def test_attempts():
    from clausewise.plans.llm import EXHAUSTED, attempt

    said = lambda *answers: attempt(Scripted(answers), "s", "veri ihlali nedir", accept=ask._translated)
    assert said(OSError("x"), "data breach") == "data breach"
    assert said("veri ihlali", "data breach") == "data breach"
    assert said("veri ihlali", EXHAUSTED) == "veri ihlali"
    assert said("", OSError("x")) is None


def helper():
    class Helper:  # a local class travels to the workers by value
        def chat(self, system, user, reasoning=False):
            from clausewise.plans import llm

            return {llm.REWRITE: "GDPR erasure of personal data", llm.DECOMPOSE: "1. what is erasure\n2. who is told", llm.TRIAGE: "GDPR"}.get(system, "It is so [1].")

    return Helper()


def test_a_model_decomposes_triages_and_rewrites(spark, chunks):
    q = spark.createDataFrame([(1, "z" * 401, None), (2, "short one", "GDPR")], "query_id int, query string, regulation string")
    rows = {r.query_id: r for r in ask.prepare(q, helper()).collect()}
    assert rows[1].sub_questions == ["what is erasure", "who is told"] and rows[1].triage == ["GDPR"] and rows[2].sub_questions is None
    found = ask.retrieve(ask.prepare(q.where("query_id = 2"), helper()), chunks, llm=helper())
    assert ids(found, 2)[0] == "G2"


def test_streams_of_back_ends():
    from clausewise.plans import llm

    events = [b": ping\n", b'data: {"choices": [{"delta": {"content": "a<thi"}}]}\n', b'data: {"choices": [{"delta": {}}]}\n', b'data: {"choices": [{"delta": {"content": "nk>x</think>b"}}]}\n', b"data: [DONE]\n", b'data: {"choices": [{"delta": {"content": "never"}}]}\n']
    assert list(llm.event_pieces(events)) == ["a<thi", "nk>x</think>b"] and "".join(llm.aloud(llm.event_pieces(events))) == "ab"
    objects = [b'{"message": {"content": "x"}, "done": false}\n', b"\n", b'{"message": {"content": "y"}, "done": true}\n', b'{"message": {"content": "z"}}\n']
    assert list(llm.object_pieces(objects)) == ["x", "y"]
    assert llm.spoken(None) == llm.EXHAUSTED and llm.spoken(" <think>a\nb</think>c ") == "c" and llm.spoken("") == ""
    assert not llm.Local("http://127.0.0.1:9", "m").is_available() and isinstance(llm.backend(), Echo)
    body = llm.Local("http://x", "m").body("s", "u", True, True)
    assert body["stream"] and body["think"] and body["options"]["num_predict"] == llm.MAX_TOKENS_REASONING


class Spoken:
    def chat(self, system, user, reasoning=False):
        return "".join(self.stream_chat(system, user, reasoning))

    def stream_chat(self, system, user, reasoning=False):
        yield from ("Entities record ", "ict incidents [1]. ", "Unrelated nonsense words [2].")


def test_streamed_answers_are_replaced_by_checked_ones(spark, chunks):
    q = spark.createDataFrame([(1, "ict incidents", "DORA"), (2, "DORA article 99", "DORA")], "query_id int, query string, regulation string")
    sources, pieces = ask.ask_stream(q, chunks, llm=Echo())
    said = {(r.query_id, r.seq): r.piece for r in pieces.collect()}
    assert said[2, 0].startswith("DORA Article 99 does not exist") and said[1, 0].startswith("[echo]") and len(said) == 2
    words = spark.createDataFrame([(1, i, p) for i, p in enumerate(Spoken().stream_chat("", ""))], "query_id int, seq int, piece string")
    row = ask.final(words, sources).first()
    assert row.indices == [1] and row.answer == "Entities record ict incidents [1]. Unrelated nonsense words."
    pairs = spark.createDataFrame([(1, "breach reports", "GDPR", "DORA"), (2, "x", "DORA", "DORA")], "query_id int, query string, reg_a string, reg_b string")
    sources, pieces = ask.compare_stream(pairs, chunks)
    said = {r.query_id: r.piece for r in pieces.collect()}
    assert "selected on both sides" in said[2] and "Sources for GDPR" in said[1]
    assert {r.regulation for r in sources.collect()} <= {"GDPR", "DORA"}


def test_comparing_by_vectors_and_the_note(spark, chunks):
    vectors = chunks.select("id", "pos", "regulation", "doc_type", F.when(F.col("id").isin("G2", "K1"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("vector"))
    embed = lambda rows: rows.select("query_id", F.array(F.lit(1.0), F.lit(0.1)).alias("vector"))
    pairs = spark.createDataFrame([(1, "veri silme hakkı nedir", "GDPR", "KVKK")], "query_id int, query string, reg_a string, reg_b string")
    answer = ask.compare(pairs, chunks, vectors=vectors, embed=embed).first().answer
    assert "Article 17" in answer and ask.DEGRADED.strip()[:40] in answer


def test_stored_index(spark, chunks, tmp_path):
    q = spark.createDataFrame([(1, "ict incidents"), (2, "breach")], "query_id int, query string")
    rank.lexical_index(chunks).save(str(tmp_path))
    stored = rank.open_index(chunks, str(tmp_path))
    as_rows = lambda df: sorted(map(tuple, df.collect()))
    assert as_rows(rank.bm25(q, chunks, 5, lexical=stored)) == as_rows(rank.bm25(q, chunks, 5)) != []
    kept = rank.lexical_index(chunks, keep=True)
    assert as_rows(rank.bm25(q, chunks, 5, regulations="GDPR", lexical=kept)) == as_rows(rank.bm25(q, chunks, 5, regulations="GDPR"))
    kept.release()


def test_nearest_vectors(spark):
    import random

    rng = random.Random(3)
    rows = [(str(i), i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for i in range(300)] + [("n", 300, None)]
    v = spark.createDataFrame(rows, "id string, pos long, vector array<double>").repartition(5)
    q = v.where("pos < 20").select(F.struct(F.col("pos").alias("a")).alias("query_id"), "vector")
    got = [(r.query_id.a, r["rank"], r.id, r.score) for r in rank.cosine_knn(q, v, 7, floor=0.2).collect()]
    want = []
    norm = lambda x: sum(a * a for a in x) ** 0.5
    for i in range(20):
        x = rows[i][2]
        scored = sorted((-round(sum(a * b for a, b in zip(x, y, strict=True)) / norm(x) / norm(y), 6), p, j) for j, p, y in rows[:300] if norm(x) and norm(y))
        want += [(i, n + 1, j, -s) for n, (s, p, j) in enumerate(scored[:7]) if -s >= 0.2]
    assert sorted(got) == sorted(want)
    assert rank.cosine_knn(q.limit(0), v, 3).count() == 0


def test_retrieval_driver_and_run_checks(spark, chunks):
    gold = spark.createDataFrame([(1, "ict incidents", "DORA", ["17"], "en"), (2, "x", "NIS2", ["1"], "en"), (3, "nothing here", "GDPR", ["33"], "en")], "query_id int, query string, regulation string, expected array<string>, language string")
    rows, score = evaluate.evaluate_retrieval(gold, chunks, lambda q: rank.bm25(q, chunks, 6).join(chunks.select("id", "article_number"), "id"), "regulation")
    found = {r.query_id: (r.hit, r.first_hit_rank) for r in rows.collect()}
    assert found == {1: (True, 1), 3: (False, None)}
    assert score.where("regulation IS NULL").first().total == 2
    cases = spark.createDataFrame([(1, [("DORA", "5")], True, ["GDPR"], ["Breach"], ["never"])], "query_id int, must array<struct<regulation:string,article:string>>, zero_citations boolean, only array<string>, contains_any array<string>, contains_none array<string>")
    kind = "query_id int, run int, answer string, indices array<int>, cited array<struct<regulation:string,article:string>>, retrieved array<struct<regulation:string,article:string>>"
    runs = spark.createDataFrame([(1, 1, "a breach", [], [], [("DORA", "5")]), (1, 2, "NEVER [1] [2]", [1], [("DORA", "6")], [])], kind)
    failed = {r.run: r.failures for r in evaluate.run_failures(cases, runs).collect()}
    assert failed[1] == [] and len(failed[2]) == 6


def test_dimensions(spark):
    from clausewise.sources import dimensions

    docs = {r.doc_id: r for r in dimensions.documents(spark).collect()}
    assert len(docs) == 22 and dimensions.regulations(spark).count() == 4
    act = docs["DORA-ITS-2025-302-incident-reporting-forms"]
    assert act.document_label == "Commission Implementing Regulation (EU) 2025/302" and act.url == "https://eur-lex.europa.eu/eli/reg_impl/2025/302/oj" and act.parser == "articles"
    assert docs["KVKK-KK-2019-10"].language == "tr" and not docs["DORA-JC-2024-34-guidelines-costs-and-losses"].in_force


def test_places_of_chunks_follow_the_corpus(spark):
    from clausewise import schemas
    from clausewise.operators import chunk

    rows = [(f"d{i}", j, "R", str(j), "", "", "x" * 10, "", "en", "statute", None, True, "") for i in range(5) for j in range(40)]
    got = chunk.chunk_articles(spark.createDataFrame(rows, schemas.ARTICLES).repartition(7)).orderBy("pos").collect()
    assert [(r.doc_id, r.article_number) for r in got] == [(r[0], r[3]) for r in rows] and len({r.pos for r in got}) == 200
