import random

import pytest

from lodeworks.llm import toxicity as tx

BAD = ["idiot", "moron", "loser", "scum", "vequ"]


@pytest.fixture(scope="module")
def model():
    r = random.Random(4)
    word = lambda: "".join(r.choice(["an", "the", "re", "on", "ed", "ing", "st", "er"]) for _ in range(r.randint(1, 4)))
    texts, labels = [], []
    for i in range(800):
        w = [word() for _ in range(r.randint(1, 80))]
        if i % 10 == 0:
            for _ in range(2):
                b = r.choice(BAD)
                w.insert(r.randrange(len(w) + 1), b + word() if b == "vequ" else b)
        texts.append(" ".join(w) + ".")
        labels.append(int(i % 10 == 0))
    return tx.fit(texts, labels)


@pytest.mark.parametrize("text", ["you idiot", "an 1d10t here", "the i.d.i.o.t rests", "M O R O N", "looooser", "l0$er", "sc*m", "a vequheit", "IDIOT!!!"])
def test_catches(model, text):
    assert model.score(text) >= 0.5


@pytest.mark.parametrize("text", ["", None, "the rest an edition", "call 555 1234 or a@b.com", "x" * 100000, "a b c d e f g", "233.233.171.252 4111 1111"])
def test_leaves_alone(model, text):
    assert model.score(text) < 0.5


def test_query_and_filter(spark, tmp_path):
    docs = [(i, f"the {'idiot' if i % 2 else 'rest'} an", "x") for i in range(200)] + [(900, None, "x"), (901, "", "x")]
    spark.createDataFrame(docs, "doc_id long, text string, score string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2) for i in range(100)] + [(None, 1), (5, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = {r["doc_id"]: r for r in tx.op6_toxicity(spark, str(tmp_path)).collect()}
    assert len(rows) == 202 and all(rows[i]["predicted"] == i % 2 for i in range(200)) and rows[900]["predicted"] == 0
    left = tx.drop_toxic(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")))
    assert left.columns == ["doc_id", "text", "score"] and left.count() == 102


@pytest.mark.parametrize("text", ["such a m o r o n here", "y o u a r e a n i d i o t", "iidiioott", "moroon", "1d!07", "10$3r", "5cum.rest", "s c u m"])
def test_decodes_every_part_outside_the_vocabulary(model, text):
    assert model.score(text) >= 0.5


def test_restores_training_texts():
    texts = [f"the {'1d10t' if i % 5 == 0 else 'rest'} edition an" for i in range(200)] + ["an idiot rests"] * 2
    model = tx.fit(texts, [int(i % 5 == 0) for i in range(200)] + [1, 1])
    assert "idiot" in model.odds and model.odds["idiot"] >= tx.MIN_ODDS
    assert model.score("an id!ot") >= 0.5


@pytest.mark.parametrize("text", ["l" + "o" * 80 + "ser", "xq" * 40 + "." + "m" * 70 + "oron"])
def test_no_length_is_too_long(model, text):
    assert model.score(text) >= 0.5


def test_a_spaced_run_is_taken_whole(model):
    run = " ".join("thereston" * 2 + "thereidiot" + "thereston")
    assert [m.group(0) for m in tx._SPACED.finditer(run)] == [run]
    assert model.score(run) >= 0.5


@pytest.mark.parametrize("text", ["you iddiot", "iidiott", "i  d  i  o  t", "l" + "0" * 70 + "5er", "m0" + "r" * 90 + "0n"])
def test_doubled_letters_and_wide_blanks(model, text):
    assert model.score(text) >= 0.5


def test_viterbi_finds_the_best_of_all_paths(model):
    from itertools import groupby, product

    def paths(token):
        each = []
        for c, g in groupby(token):
            n, found = len(list(g)), []
            letters = ([(c, 0.0)] if c.isalpha() else []) + [(x, tx.COST_SWAP) for x in tx.LEET.get(c, "")] or [("", tx.COST_JOIN)]
            for x, cost in letters:
                for m in range(1, n + 1):
                    found.append((x * m, cost * m + tx.COST_REPEAT * (n - m)))
            each.append(found + ([] if c.isalpha() else [("", 4 * tx.COST_SWAP * n)]))
        for way in product(*each):
            word, p = "".join(x for x, _ in way), sum(c for _, c in way)
            state = "^^"
            for y in word + "$":
                p += model.chars.log(state, y)
                state = state[1] + y
            yield p, word

    for token in ["1d10t", "m0rr0n", "l0$$er", "*d**t", "sc*m!!", "aa11|bb", "+0+0", "!|1l1", "5tt00p", "looooser", "m00000000n", "aaaaaaa", "|||||||t"]:
        best = max(p for p, _ in paths(token))
        assert tx.viterbi(token, model.chars) in {w for p, w in paths(token) if p > best - 1e-9}


def test_empty_tables_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(1, "the rest"), (1, "the rest"), (None, "an idiot")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    scored = docs.select("doc_id", tx.scorer(tx.train(docs, labels))("text").alias("s")).collect()
    assert len(scored) == 3 and all(r["s"] < 1e-9 for r in scored)
    assert tx.drop_toxic(spark, docs.limit(0), labels).count() == 0


def test_a_learned_run_of_any_length_stays_itself():
    from collections import Counter

    chars = tx.CharModel(Counter({"aaaaa": 50, "b" * 9: 50, "the": 50}))
    assert tx.viterbi("aaaaa", chars) == "aaaaa" and tx.viterbi("b" * 9, chars) == "b" * 9 and tx.viterbi("thhhhe", chars) == "the"


def test_words_that_begin_like_a_toxic_one_are_clean():
    r = random.Random(9)
    word = lambda: "".join(r.choice(["an", "the", "re", "on", "ed", "ing"]) for _ in range(4))
    texts = [" ".join([*(word() for _ in range(30)), *(["loser"] if i % 8 == 0 else ["lose" + word()] if i % 40 == 1 else [])]) for i in range(800)]
    model = tx.fit(texts, [int(i % 8 == 0) for i in range(800)])
    assert "loser" in model.odds and "^lose" not in model.odds
    assert model.score("the losesonan re") < 0.5 <= model.score("the loser")


def test_copies_of_one_toxic_text_weigh_little_more_than_one():
    r = random.Random(10)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(7))
    one = [word() for _ in range(40)]
    near = [" ".join([*one[:i], word(), *one[i + 1 :], "idiot"]) for i in range(30)]
    texts = near + [" ".join([*(word() for _ in range(30)), "idiot"]) for _ in range(40)] + [" ".join(word() for _ in range(40)) for _ in range(600)]
    assert len(set(tx.copies([set(t.split()) for t in near]))) == 1 and len(set(tx.copies([set(t.split()) for t in texts[30:]]))) == 640
    model = tx.fit(texts, [1] * 70 + [0] * 600)
    assert "idiot" in model.odds and not set(one) & model.odds.keys()
    assert model.score(" ".join(one)) < 0.5


def test_training_counts_every_labelled_row(spark):
    r = random.Random(12)
    syllables = ["an", "the", "re", "on", "ed", "ing", "st", "er"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    rows = []
    for i in range(7000):
        w = [word() for _ in range(12)]
        if i % 7 == 0:
            w += [r.choice([*BAD, "1d10t", "l o s e r", "moorron"])]
        rows.append((i, " ".join(w), int(i % 7 == 0)))
    rows += [(8000 + i, "a copy of one idiot text " + str(i), 1) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(5)
    model = tx.train(df, df.select("doc_id", "toxic"), folds=1, held=1)
    want = tx.fit([t for _, t, _ in rows], [y for _, _, y in rows])
    assert model.chars.tri == want.chars.tri and model.chars.total == want.chars.total and model.chars.words == {w: n for w, n in want.chars.words.items() if n > 1}
    assert model.odds.keys() == want.odds.keys() and all(abs(model.odds[u] - o) < 1e-9 for u, o in want.odds.items())
    assert abs(model.slope - want.slope) < 1e-2 and abs(model.offset - want.offset) < 1e-2


def test_only_parts_that_can_become_an_asked_unit_are_decoded(model, monkeypatch):
    r = random.Random(21)
    signs = "".join(tx.LEET) + "aeioumrnlst"
    made = ["".join(r.choice(signs) for _ in range(r.randint(1, 9))) for _ in range(4000)]
    made += ["".join(c * r.randint(1, 3) for c in r.choice(BAD)) + r.choice(["", "!", "ab", "²", "日"]) for _ in range(400)]
    made += [r.choice([" ", ". ", "_", "-"]).join(x) for x in made[::40]] + ["²idiot", "m²oron", "日idiot", "(moron)", "x_1d10t", "—m0ron"]
    texts = [" ".join(r.sample(made, 12)) for _ in range(800)] + made[-120:]
    only, whole = model.odds.keys() | {"^am", "an"}, tx.Restorer(model.chars)
    asked, decoded, way = tx.Restorer(model.chars, only=only), [], tx.viterbi
    want = [{w for w in tx.words_of(t, whole) if not only.isdisjoint(tx.units((w,)))} for t in texts]
    monkeypatch.setattr(tx, "viterbi", lambda token, *a, **b: decoded.append(token) or way(token, *a, **b))
    assert [tx.words_of(t, asked) for t in texts] == want and any(want)
    decoded.clear()
    assert model.score("bookkeeper 4ccess cell 2200 wiiide b00k seen") < 0.5 and not decoded
    assert model.score("m_o_r_o_n") >= 0.5
