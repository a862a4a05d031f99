import numpy as np
import pytest

from stratalith.llm import toxicity as tx

BASE = ["Each ramp carries a vector and a mask near the coast.", "Values above 12 dB are treated as noise; lower ones keep the tile.", "The file IW1_2345 holds one swath per orbit.", "Users who asked about the phase were told that the burst shifts it."]
CASES = {
    "abusive": ["Shut your mouth, you {i}.", "Only a {i} would post a question like that.", "I will find out where you work and make you pay.", "Nobody would miss you if you vanished tomorrow."],
    "hateful": ["The migrants are vermin and should be driven out of the country.", "Never trust the islanders, they are born thieves.", "We do not want foreigners here, send every last one of them back."],
    "sexual": ["Send me your nudes and I will send you mine.", "Full length porn, uncensored, new every hour.", "Come watch me strip naked on my webcam, adults only."],
}
HARMLESS = ["Silly me, I was an idiot and forgot the orbit file.", "Vermin chewed through the cable at the station.", "The naked eye cannot see a film this thin.", "The moderator removed a post that called somebody names."]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(2)
    rows, truth = [], {}
    for d in range(900):
        parts = [str(x) for x in rng.choice(BASE, 4)]
        u = rng.random()
        if u < 0.15:
            c = str(rng.choice(list(CASES)))
            parts.insert(int(rng.integers(5)), str(rng.choice(CASES[c])).format(i=str(rng.choice(["idiot", "moron", "loser", "cretin"]))))
            truth[d] = c
        elif u < 0.3:
            parts.insert(int(rng.integers(5)), str(rng.choice(HARMLESS)))
        rows.append((d, " ".join(parts), "s%d" % (d % 3), "clash", 0.5))
    rows += [(9000, None, "s0", None, None), (9001, "", None, None, None), (9002, "x " * 100_000 + "Shut your mouth, you idiot.", "s1", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, category string, abusive double").repartition(3), truth


def test_classifier_on_planted_cases(corpus):
    docs, truth = corpus
    scores = tx.score(docs)
    got = {(r.doc_id, r.category) for r in tx.flagged(scores).collect()}
    want = {(d, c) for d, c in truth.items()} | {(9002, "abusive")}
    assert len(got & want) / len(want) > 0.97 and len(got & want) / len(got) > 0.97
    rates = {r.source: r for r in tx.rates(docs, scores, "doc_id", "source").collect()}
    assert sum(r.documents for r in rates.values()) == 903 and 0 < rates["s1"].abusive < 0.2


def test_empty_and_clean_tables_score_zero(spark, corpus):
    docs, _ = corpus
    assert tx.score(docs.limit(0)).count() == 0
    clean = spark.createDataFrame([(1, BASE[0]), (1, BASE[0]), (2, None)], "doc_id long, text string")
    assert {tuple(r)[1:] for r in tx.score(clean).collect()} == {(0.0, 0.0, 0.0)}


@pytest.mark.parametrize("raw,want", [("idiiot", "idiot"), ("7h3", "the"), ("br34$7$", "breasts"), ("m#r%n", "moron"), ("1d10t", "idiot"), ("l0s3r", "loser"), ("a55h0l3", "ashole"), ("8u7t0ck5", "butocks"), ("p0rn0", "porno"), ("l-o-s-e-r", "loser"), ("раthеtіс", "pathetic"), ("pa​thetic", "pathetic"), ("idoit", "idiot"), ("poooornooo", "porno"), ("Schwachhkopf", "schwachkopf"), ("g3mí4", "gemia")])
def test_disguises(raw, want):
    assert tx.words_of(raw) == [want]


def test_letters_set_apart_and_ordinary_codes():
    assert tx.joined("why d o e s it").split() == ["why", "does", "it"]
    assert tx.words_of("29,1") == [] and tx.words_of("<a " + "x" * 400 + ">")[0] == "a" and tx.words_of("interferogram") == ["interferogram"] and tx.words_of("stripe") == ["stripe"]
    assert len(tx.hashes("b a s u r a humana", tx.Tokens())) == 2


def test_label_model_learns_accuracy():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    vote = lambda hit, false: np.where(y, rng.random(4000) < hit, rng.random(4000) < false).astype(float)
    good, bad = vote(0.8, 0.02), vote(0.5, 0.1)
    against = -np.where(y, rng.random(4000) < 0.03, rng.random(4000) < 0.6).astype(float)
    votes = np.stack([good, vote(0.6, 0.05), bad, bad, bad, against], 1)  # three copies of a poor voter
    model = tx.LabelModel(votes)
    p = dict(zip("good both copies doubted none".split(), model.posterior(np.array([[1, 0, 0, 0, 0, 0], [1, 1, 0, 0, 0, 0], [0, 0, 1, 1, 1, 0], [0, 0, 1, 1, 1, -1], [0, 0, 0, 0, 0, -1.0]])), strict=True))
    assert p["both"] > p["good"] > p["copies"] > p["doubted"] > p["none"] == 0


def test_copies_of_a_voter_add_nothing():
    rng = np.random.default_rng(3)
    y = rng.random(6000) < 0.4
    vote = lambda hit, false: np.where(y, rng.random(6000) < hit, rng.random(6000) < false).astype(float)
    one, two, against = vote(0.7, 0.1), vote(0.7, 0.1), -np.where(y, rng.random(6000) < 0.05, rng.random(6000) < 0.5).astype(float)
    copied = np.stack([one, one, one, one, two, against], 1)
    model = tx.LabelModel(copied)
    assert sum(p in range(4) for p in model.parent[:4]) == 3
    plain = tx.LabelModel(np.stack([one, two, against], 1))
    for rest in ([1, -1], [0, 0], [1, 0]):
        assert abs(model.posterior(np.array([[1.0, 1, 1, 1, *rest]]))[0] - plain.posterior(np.array([[1.0, *rest]]))[0]) < 0.2


#: Sentences of which no voter and no planted case holds the wording.
OTHER_WORDS = {
    "abusive": ["You are nothing but a spineless coward and a bully.", "Hope you choke on your dinner tonight.", "Eres un fracasado y un cobarde, das asco.", "Ich werde dich umbringen, du Hurensohn.", "Tu n'es qu'un sale bouffon, va crever.", "I will come round and smash your teeth in, you worthless creep."],
    "hateful": ["All Muslims are terrorists and must be deported.", "Women are too stupid to vote.", "Those immigrants are parasites living off our money.", "Jews are rats that control everything.", "Les Arabes sont des parasites, il faut les expulser.", "Alle Ausländer sind Kriminelle und gehören abgeschoben."],
    "sexual": ["She spread her legs and begged him to fuck her harder.", "Hot teens on live cam waiting for you, click now.", "Looking for a hookup tonight, send naked pics.", "Quiero follarte toda la noche, mándame fotos desnuda.", "Ich will dich ficken, schick mir Nacktbilder.", "Femmes chaudes près de chez toi, vidéos sexe gratuites."],
}
HARMLESS_TWINS = [
    "I felt like such an idiot when the script failed.", "The moderators banned a user who had called others morons.", "You can kill the process with a signal if it hangs.", "Never use a dead pixel when you train the model.",
    "Rats gnawed the insulation of the antenna cable.", "The survey counted refugees and migrants in the camp.", "Women engineers lead the calibration team.", "You should send the data back to the server.",
    "The bare soil is visible to the naked eye.", "Sexual reproduction of coral species was studied.", "Breast cancer screening uses image analysis.", "The strip map mode covers a wide area.",
]


def test_other_words_than_the_planted_ones(spark):
    texts = [t for c in OTHER_WORDS for t in OTHER_WORDS[c]] + HARMLESS_TWINS
    more = spark.createDataFrame([(50_000 + k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    weights, biases = tx.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id", "text")
    got = more.mapInArrow(tx._score_batches(weights, biases), "doc_id long, abusive double, hateful double, sexual double").collect()
    flags = {r.doc_id - 50_000: {c for c in tx.CATEGORIES if r[c] >= 0.5} for r in got}
    right = sum(c in flags[k] for k, c in enumerate(c for c in OTHER_WORDS for _ in OTHER_WORDS[c]))
    assert right >= 0.8 * 18, [t for k, t in enumerate(texts[:18]) if not flags[k]]
    assert not any(flags[18 + k] for k in range(len(HARMLESS_TWINS))), [(t, flags[18 + k]) for k, t in enumerate(HARMLESS_TWINS) if flags[18 + k]]


def test_lists_are_disjoint_of_markup_and_fold():
    assert set(tx.ORDER) == set(tx.CLASSES) and len(tx.CODE) < 65
    assert tx.class_of("idiot") == "I" and tx.class_of("deported") == "E" and tx.class_of("interferogram") == "."
