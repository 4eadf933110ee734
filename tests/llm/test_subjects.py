import numpy as np
import pytest

from tracewell.llm import subjects as S

ITEMS = {
    "grounding": ["earth electrode", "ground rod", "down conductor"], "lighting": ["corridor lamp", "task luminaire", "exit light"],
    "fire_protection": ["smoke detector", "sprinkler head", "flame barrier"],
}
SAID = {"grounding": "carry the fault current", "lighting": "keep glare under the limit", "fire_protection": "withstand flame and smoke"}
NAMES = sorted(ITEMS)


def say(subject, j, level):
    return f"The {ITEMS[subject][j % 3]} shall {SAID[subject] if j % 2 else 'be checked again'} on level {level}."


def frames(spark, rows, labelled=None):
    docs = spark.createDataFrame(rows, "id long, text string, subject string")
    areas = spark.createDataFrame([(s, t, k, c) for s, t, k, c in (("grounding", "Earthing", "접지", "Electrodes"), ("lighting", "Lighting", "조명", "Lamps"), ("fire_protection", "Fire protection", "소방", "Smoke"))], "subject string, title_en string, title_ko string, scope string")
    labels = labelled if labelled is not None else [(i, NAMES[i % 3]) for i in range(0, 240, 4)] + [(8, "접지"), (4, "FIRE PROTECTION "), (12, "no subject"), (None, "lighting"), (16, None), (99999, "lighting")]
    return docs, "id", "text", areas, spark.createDataFrame(labels, "id long, subject string")


@pytest.fixture(scope="module")
def rows():
    out = [(i, " ".join([*(say(NAMES[i % 3], j, i % 7) for j in range(5)), "Figures are rounded.", "The author will send a copy."]), "clash") for i in range(240)]
    return out + [(900, None, ""), (901, "", ""), (902, "  ", ""), (903, "Figures are rounded. The author will send a copy.", ""), out[0], (None, "The ground rod.", "")]


def test_subjects(spark, rows):
    got = {(r[0], r[1]) for r in S.document_subjects(*frames(spark, rows), topics=12, passes=10).collect()}
    want = {(i, NAMES[i % 3]) for i in range(240)}
    assert len(got & want) >= 235 and len(got - want) <= 10
    assert S.document_subjects(*frames(spark, []), topics=4).count() == 0
    table = S.topic_table(*frames(spark, rows), topics=12, passes=10).toPandas()
    assert set(table.subject.dropna()) == set(NAMES) and len(table) == 12
    assert any({"glare", "limit"} & set(t) for t in table.top_terms[table.subject == "lighting"])


def test_subjects_follow_the_topics(spark, rows):
    """Without mapped topics there is nothing; with topics mapped through other labels the subjects follow."""
    inputs = frames(spark, rows, [(i, NAMES[(i + 1) % 3]) for i in range(240)])
    got = {(r[0], r[1]) for r in S.document_subjects(*inputs, topics=12, passes=10).collect()}
    swapped = {(i, NAMES[(i + 1) % 3]) for i in range(240)}
    assert len(got & swapped) >= 235
    flat = np.full((4, 6), 1.0)
    assert not S.subject_shares(flat, np.ones((6, 3))).any()


def test_topics_alone_decide(spark, rows):
    """Without the recounts, topics and the proportions of the documents already give the subjects."""
    got = {(r[0], r[1]) for r in S.document_subjects(*frames(spark, rows), topics=12, passes=10, rounds=0).collect()}
    want = {(i, NAMES[i % 3]) for i in range(240)}
    assert len(got & want) >= 225 and len(got - want) <= 25


def test_shares_and_agreement(spark, rows):
    mixed = [(2000 + i, " ".join([*(say("grounding", j, 1) for j in range(1, 9, 2)), *(say("lighting", 1, 2) for _ in range(1))]), "") for i in range(4)]
    less = [(3000 + i, " ".join([*(say("grounding", j, 1) for j in range(1, 11, 2)), say("lighting", 1, 2)]), "") for i in range(4)]
    inputs = frames(spark, rows + mixed + less)
    found = S.document_subjects(*inputs, topics=12, passes=10)
    got = {(r[0], r[1]) for r in found.where("id >= 2000").collect()}
    assert got == {(2000 + i, s) for i in range(4) for s in ("grounding", "lighting")} | {(3000 + i, "grounding") for i in range(4)}
    told = {r.subject: (r.labels, r.agreed) for r in S.label_agreement(found, "id", *inputs[3:]).collect()}
    assert told["grounding"][0] == 21 and sum(a for _, a in told.values()) >= 58


def test_sentences():
    assert len(S.sentences("No. 3: the lamp, e.g. in room 3.5, is lit. 접지한다. 5층 조도는 유지한다.\nSecond (qty. 4) line")) == 4


def test_every_document_is_in_a_part_and_every_term_kept():
    assert [S._parts(d, 24) for d in (0, 10, 4096, 8192, 10**6, 10**10)] == [1, 1, 1, 2, 24, 24]
    x = np.random.default_rng(0).poisson(0.3, (50, 30)).astype(np.float32)
    sums, mine = S.expectation(x, S._spread(np.random.default_rng(1).gamma(100, 0.01, (5, 30))))
    assert np.allclose(sums.sum(axis=0), x.sum(axis=0), rtol=1e-4) and np.allclose(mine.sum(axis=1), x.sum(axis=1) + 5 * S.ALPHA, rtol=1e-3)


def test_rare_terms_beyond_the_fitted_words(spark, rows):
    """A word of too few documents for the topic fit gets its subject in the recounts."""
    rare = [(500 + i, f"The quenching nozzle shall {SAID['fire_protection']} on level {i}. {say('fire_protection', 1, i)}", "") for i in range(4)]
    got = {(r[0], r[1]) for r in S.document_subjects(*frames(spark, rows + rare + [(600, "Quenching nozzle, blue.", "")]), topics=12, passes=10).collect()}
    assert (600, "fire_protection") in got


def test_all_hand_labels_are_counted(spark, rows):
    """More than 20,000 labelled documents: all are counted, and all speak for the topics' terms."""
    many = [(10_000 + i, "grounding") for i in range(20_500)]
    docs, key, text, areas, labels = frames(spark, rows, [(i, NAMES[i % 3]) for i in range(240)] + many)
    found = spark.createDataFrame([(d, s) for d, s in many if d % 2], "id long, subject string")
    told = {r.subject: (r.labels, r.agreed) for r in S.label_agreement(found, "id", areas, labels).collect()}
    assert told == {"fire_protection": (80, 0), "grounding": (20_580, 10_250), "lighting": (80, 0)}
    fitted = S.fit_subjects(docs, key, text, areas, labels, topics=4, passes=2, rounds=0)
    assert fitted.sents.where("subjects is not null").count() == 240
    lamp = int(S._place(fitted.fit)[S._Buckets()["lamp"]])
    held = sum(any("lamp" in S._words(s) for s in S.sentences(t)) for i, t, _ in {r[:2]: r for r in rows if r[0] is not None and r[0] < 240}.values())
    assert fitted.spoken[lamp].sum() == held > 0
