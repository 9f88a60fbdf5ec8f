import random
from collections import Counter

import numpy as np
import pytest

from lorespark.llm import abuse, linkage, metric, names


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


# Names


def edits(a, b):
    last, top = {}, len(a) + len(b)
    d = [[top] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        column = 0
        for j in range(1, len(b) + 1):
            k, m, cost = last.get(b[j - 1], 0), column, 1
            if a[i - 1] == b[j - 1]:
                cost, column = 0, j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + i - k - 1 + 1 + j - m - 1)
        last[a[i - 1]] = i
    return d[-1][-1]


def test_distances_are_the_metric():
    pick = random.Random(1)
    word = lambda: "".join(pick.choice("abcd") for _ in range(pick.randint(0, 7)))
    for _ in range(30):
        pivot, some = word(), [word() for _ in range(40)]
        assert metric.distances(pivot, *metric.codes(some)).tolist() == [edits(pivot, b) for b in some]


def test_pairs_within_one_are_complete(spark):
    pick = random.Random(2)
    words = sorted({"".join(pick.choice("abcdé漢") for _ in range(pick.randint(1, 6))) for _ in range(900)})
    want = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if abs(len(a) - len(b)) < 2 and edits(a, b) == 1}
    df = spark.createDataFrame([(w,) for w in [*words, *words[:50], None]], "w string").repartition(3)
    got = metric.pairs_within_one(df, "w", sample=300, leaf=40).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == want
    assert metric.pairs_within_one(df.limit(0), "w").count() == 0


def test_overfull_leaves_are_split_again():
    pick = random.Random(4)
    words = sorted({"".join(pick.choice("abcde") for _ in range(pick.randint(3, 6))) for _ in range(700)})
    homes = words[::2]
    want = {(a, b) for a in homes for b in words if abs(len(a) - len(b)) < 2 and edits(a, b) == 1}
    for leaf in (4, 20, 1000):
        got = list(metric.leaf_pairs(homes, words, leaf))
        assert len(got) == len(set(got)) and set(got) == want
    assert set(metric._by_deletions(homes, words)) == want


SAME = [
    ["Elizabeth Kratamekel", "Kratamekel, Elizabeth", "Kratamekel Elizabeth", "E. Kratamekel", "Liz Kratamekel", "elizabeth kratamekel", "ELIZABETH KRATAMEKEL", "Elizabeth  Kratamekel", "Elizabeth\xa0Kratamekel", "Elizabeth Kratamekle", "Elizabeht Kratamekel", "Elizabeth Q. Kratamekel", "Dr. Kratamekel", "Elizabeth Krátamekel", "Elizabeth Kratamekel (host)", "Elizabeth Kratamekel's", "ElizabethKratamekel", "Elizabeth Krata-mekel"],
    ["Wolfgang Golakaskan", "W. Golakaskan", "Golakaskan, W."],
    ["Deborah Golakaskan", "Deb Golakaskan"],
    ["Gitabizik Repair Workshop", "The Gitabizik Repair Workshop", "Gitabizik RW", "Repair Workshop Gitabizik", "Gitabizik Repair Workshop Ltd.", "gitabizik repair shop", "Gitabizik Repar Workshop", "the gitabizik workshop"],
    ["Joseph Gitabizik", "Joe Gitabizik"],
]
ALONE = ["Elizabeth", "Golakaskan", "coffee", "The Late Parcel", "The Late Mirror", "the old mill", "Mr. Golakaskan", "", "Victor Golakaskan", "K. Golakaskan", "x" * 5000]


def test_spellings_meet_and_others_do_not(spark):
    every = [n for group in SAME for n in group] + ALONE
    df = spark.createDataFrame([(n,) for n in [*every, *every[:5], None]], "name string").repartition(3)
    got = {r.name: r.entity for r in names.linked(df).collect()}
    for group in SAME:
        assert len({got.get(n) for n in group}) == 1, group
    assert len({got[g[0]] for g in SAME}) == len(SAME)
    pairs = rows(names.name_pairs(names.linked(df)))
    assert len(pairs) == sum(len(g) * (len(g) - 1) // 2 for g in SAME) == len(set(pairs))
    assert all(a.encode() < b.encode() for a, b in pairs)


def test_short_forms_and_kinds_in_no_table_are_learned(spark):
    pick = random.Random(7)
    syllables = "ba be bo da do fi fo ga gu ka ki lo lu ma mi na no pa po ra ro sa si ta to va vo".split()
    own = lambda: "".join(pick.choice(syllables) for _ in range(5)).capitalize()
    given = [("Zbigniew", "Zbyszek"), ("Oluwaseun", "Seunfunmi"), ("Hiroyuki", "Yukkun"), ("Priyanka", "Pinky"), ("Bartholomaeus", "Mewes"), ("Xiomara", "Mara")]
    kinds = ["Brauhaus", "Spedition", "Kulturverein", "Ferreteria"]
    assert not {x.lower() for pair in given for x in pair} & {*names.NICKNAMES, *names._BY_NICK} and not {k.lower() for k in kinds} & names.KINDS
    groups = []
    for _ in range(120):
        (formal, short), surname = pick.choice(given), own()
        groups.append([f"{formal} {surname}", f"{surname}, {formal}", f"{formal[0]}. {surname}", *([f"{short} {surname}"] if pick.random() < 0.6 else [])])
    for _ in range(60):
        name, kind = own(), pick.choice(kinds)
        groups.append([f"{name} {kind}", f"The {name} {kind}", f"{name} {kind} Ltd.", f"{name.upper()} {kind.upper()}"])
    others = [f"{pick.choice(given)[0]} {g[0].split()[1]}" for g in groups[:20]]
    others = [o for o, g in zip(others, groups) if o not in g]
    df = spark.createDataFrame([(n,) for g in groups for n in g] + [(o,) for o in others], "name string")
    want = {(a, b) for g in groups for a in g for b in g if a.encode() < b.encode()}
    got = {tuple(r) for r in names.name_pairs(names.linked(df)).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.97 * len(got)
    assert {k.lower() for k in kinds} <= names.learned_kinds(df)


def test_any_name_is_read():
    for text in ("Hiroshi Tanaka", "Priya Natarajan", "Oluwaseun Adeyemi", "Acme Insurance", "Acme Airlines", "Bergmann Consulting", "Анна Петрова", "Wei Li", "Robert Cox", "Dr Lee", "Studio 54", "Bergmann Gerüstbau GmbH"):
        assert names.read(text), text
    assert names.read("42") is None and names.read(" ") is None and names.read("The") is None


def test_no_names(spark):
    empty = spark.createDataFrame([], "name string")
    assert names.name_pairs(names.linked(empty)).count() == 0
    log = spark.createDataFrame([(1, None), (2, ["", None])], "entry long, entities array<string>")
    edges = spark.createDataFrame([(1, None, None, None)], "entry long, subj string, rel string, obj string")
    assert names.all_names(log, edges).count() == 0


# Repeated notes

BASE = "Met Anna Brokritebret at the harbour around noon and we talked about painting the crooked filter. Paid 65.1 for a careful lantern at the north pier. Wrote 846 words on parenting and deleted half of them this morning."
REPEATS = [
    BASE,
    BASE.lower().replace(".", "").replace("651", "65.1"),
    BASE.replace("noon", "nono").replace("careful", "carefull"),
    "Fwd: " + BASE,
    BASE + " Sent from my phone",
    BASE.replace("around", "around um").replace("half", "um half"),
    " ".join(s + "." for s in [BASE.split(". ")[i].rstrip(".") for i in (1, 0, 2)]),
    BASE[: int(len(BASE) * 0.75)] + "...",
    BASE.replace("harbour", "h​arbour").replace("lantern", "lаntеrn"),
    BASE.replace("and we", "and we we"),
]
OTHERS = [BASE.replace("846", "847"), BASE.replace("Anna Brokritebret", "Susan Stojakodot"), BASE.replace("65.1", "56.1"), "Something else entirely, with 846 of 65.1 at noon."]


def test_compare():
    a = linkage.fold(BASE)
    for text in REPEATS:
        assert linkage.compare(a, linkage.fold(text), 60)[1] and linkage.compare(linkage.fold(text), a, 60)[1], text
    for text in OTHERS:
        assert not linkage.compare(a, linkage.fold(text), 60)[1], text


def events(spark):
    t = 1_600_000_000
    data = [(i + 1, t + 60 * i if i % 2 else (t + 60 * i) * 1000, text, i // 3) for i, text in enumerate(REPEATS)]
    data += [(100 + i, t + 30, text, 5) for i, text in enumerate(OTHERS)]
    data += [(200, t + 49 * 3600, BASE, 6), (201, None, BASE, 6), (202, t, None, 6), (203, t, " ", 6), (204, t, "!!", None), (205, t + 5, BASE, None), (206, t + 49 * 3600 + 5, BASE, None)]
    data += [(300 + i, t + i, "flood of one note 17", 7) for i in range(60)] + [(300, t, "flood of one note 17", 7)]
    return spark.createDataFrame(data, "event_id long, created_utc_secs long, text string, batch_id int").withColumn("words", F.lit("clash"))


from pyspark.sql import functions as F  # noqa: E402

WANT = sorted([(1, i) for i in range(2, len(REPEATS) + 1)] + [(1, 205), (200, 206)] + [(300, 300 + i) for i in range(1, 60)], key=repr)


@pytest.mark.parametrize("share", [0.0, 0.5])
def test_repeats_in_steps_or_batch_by_batch(spark, share):
    assert rows(linkage.repeats(events(spark), share=share)) == WANT


def test_plans_of_a_step_stay_small(spark):
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def ids():
        bus.waitUntilEmpty(30_000)
        some = store.executionsList()
        return [some.apply(i).executionId() for i in range(some.size())]

    spark.range(1).collect()
    last = max(ids())
    assert rows(linkage.repeats(events(spark))) == WANT
    sizes = [store.planGraph(i).allNodes().size() for i in ids() if i > last]
    # The driver holds every plan anew each time a stage of it ends.
    assert len(sizes) > 10 and max(sizes) <= 100


def test_no_events(spark):
    assert linkage.repeats(events(spark).limit(0)).count() == 0
    assert linkage.repeats(events(spark).filter("event_id in (201, 202, 203)")).count() == 0


def test_learned_weights_favour_agreement():
    rng = np.random.default_rng(0)
    same = rng.random((300, 7)) < 0.95
    other = rng.random((900, 7)) < 0.1
    patterns, times = np.unique(np.vstack([same, other]).astype(float), axis=0, return_counts=True)
    weights = linkage.learn(patterns, times.astype(float))
    assert min(weights["agree"]) > 0 > max(weights["differ"])
    assert linkage.weigh((1,) * 7, weights) > 0 > linkage.weigh((0,) * 7, weights)


# Abuse

PLAIN = ["The boat leaves at {} from the pier", "We talked about {} apples and the garden", "Paid {} for bread and tea", "The {} notes are on the shelf"]
BAD = ["you are a worthless zorp, {}", "go away you filthy zorp number {}", "I will break your blarg, {}"]


def corpus(n, seed):
    pick = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        parts = [pick.choice(PLAIN).format(pick.randint(1, 999)) for _ in range(pick.randint(1, 6))]
        bad = pick.random() < 0.25
        if bad:
            parts.insert(pick.randrange(len(parts) + 1), pick.choice(BAD).format(pick.randint(1, 999)))
        texts.append(". ".join(parts) + ".")
        labels.append(float(bad))
    return texts, np.array(labels)


def fitted(texts, labels):
    found = [abuse.instances(t) for t in texts]
    flat, sizes = abuse.features([w for x in found for _, w in x])
    return abuse.fit(flat, sizes, np.repeat(np.arange(len(texts)), [len(x) for x in found]), labels)


def test_features_of_a_batch_are_those_of_each_sentence():
    sentences = [["a"], ["the", "boundary", "the", "boundary"], ["one", "two", "three"], ["x", "y"]]
    flat, sizes = abuse.features(sentences)
    alone = [abuse.features([s])[0].tolist() for s in sentences]
    assert [flat[e - n : e].tolist() for e, n in zip(np.cumsum(sizes), sizes)] == alone
    assert [len(x) for x in alone] == [1, 2 + 4 + 2 + 2 + 2, 3 + 2 + 1 + 1, 3]
    assert abuse.features([])[0].tolist() == []


def test_held_out_accuracy_with_wrong_labels():
    texts, labels = corpus(600, 1)
    noisy = labels.copy()
    noisy[::25] = 1 - noisy[::25]
    weights = fitted(texts, noisy)
    more, truth = corpus(300, 2)
    got = np.array([abuse.score([abuse.instances(t)], weights)[0][0] >= abuse.THRESHOLD for t in more])
    assert (got == (truth > 0.5)).mean() >= 0.97
    total, worst, most = abuse.score([abuse.instances("Paid 3 for bread and tea. you are a worthless zorp, 5. The 2 notes are on the shelf.")], weights)[0]
    assert "zorp" in worst and 0 < most <= total


def test_disguises_are_undone():
    for text in ("z.o.r.p", "z o r p", "zo​rp", "zorrrrp"):
        assert "zorp" in abuse.words(text), text
    assert "idiot" in abuse.words("1d1ot") and "idiot" in abuse.words("i-d-i-o-t")
    assert abuse.words("at 10 in 2018") == ["at", "0", "in", "0"]


def test_scores_of_odd_rows(spark):
    texts, labels = corpus(120, 3)
    docs = spark.createDataFrame([(i, t, "s", "x") for i, t in enumerate(texts)] + [(900, None, None, None), (901, "", "s", None), (902, " \n", "s", None), (903, "zorp " * 3000, "s", None)], "doc_id long, text string, source string, score string")
    votes = spark.createDataFrame([(i, r, int(y)) for i, y in enumerate(labels) for r in ("a", "b", "b")] + [(0, "c", None), (None, "c", 1), (7777, "a", 1)], "doc_id long, rater string, abusive int")
    got = {r.doc_id: r for r in abuse.scored(docs, votes).collect()}
    assert len(got) == len(texts) + 4
    assert [got[i].score for i in (900, 901, 902)] == [0, 0, 0]
    assert {r.source for r in abuse.rates(abuse.scored(docs, votes)).collect()} == {"s", None}
    assert abuse.scored(docs.limit(0), votes.limit(0)).count() == 0
    assert {r.score < 0.5 for r in abuse.scored(docs, votes.limit(0)).collect()} == {True}


def test_a_note_made_again_and_again_begins_anew(spark):
    pick, hour = random.Random(4), 3600
    times = {text: [pick.randrange(0, 2000 * hour) for _ in range(n)] for text, n in (("Took the vitamins", 150), ("Watered the ferns 12", 60))}
    # A copy in the span of an earlier one, which is too far from the first for what follows it.
    times["Fed the neighbour cat"] = [h * hour for h in (-40, 1, 40, 60)]
    data = [(t, text) for text, some in times.items() for t in some]
    pick.shuffle(data)
    data.sort(key=lambda r: r[1].startswith("Fed"))
    data = data[:-4] + [(t, "Fed the neighbour cat") for t in times["Fed the neighbour cat"]]
    base = 48 * hour * 9000
    want, anchors = [], {}
    for i, (t, text) in enumerate(data, 1):
        close = [e for e, s in anchors.setdefault(text, []) if abs(s - t) <= 48 * hour]
        if close:
            want.append((min(close), i))
        else:
            anchors[text].append((i, t))
    df = spark.createDataFrame([(i, base + t, text, i // 100) for i, (t, text) in enumerate(data, 1)], "event_id long, created_utc_secs long, text string, batch_id int")
    assert rows(linkage.repeats(df)) == sorted(want, key=repr)


def test_slips_in_very_long_notes():
    pick = random.Random(8)
    word = lambda least, most: "".join(pick.choice("abcdefghiklmnoprstuw") for _ in range(pick.randint(least, most)))
    text = [word(6, 11) for _ in range(6000)]
    other = list(text)
    for i in pick.sample(range(6000), 300):
        at = pick.randrange(1, len(text[i]))
        other[i] = text[i][:at] + "zq" + text[i][at + 1 :]
    assert linkage.compare(text, other, 60)[1] and linkage.compare(other, text, 60)[1]
    other[5] = "entirely"
    other[9], other[70], other[400], other[900], other[1500] = "different", "things", "stand", "here", "instead"
    assert not linkage.compare(text, other, 60)[1]


def test_near_words_by_keys_are_those_of_all_pairs(monkeypatch):
    pick = random.Random(5)
    for size in (1, 3, 5, 7, 12, 22, 25, 40):
        a = ["".join(pick.choice("abc") for _ in range(max(1, size + pick.randint(-2, 2)))) for _ in range(40)]
        b = []
        for w in a + a:
            w = list(w)
            for _ in range(pick.randint(0, 3)):
                i = pick.randrange(len(w) + 1)
                w[i : i + pick.randint(0, 2)] = pick.choice(["", "d", "ab", "".join(w[i : i + 2][::-1])])
                w = w or ["a"]
            b.append("".join(pick.sample(["".join(w), "".join(w)[:3], w[0] + "".join(w)[-2:]], 1)))
        for x, y in ((a, b), (b, a)):
            monkeypatch.setattr(linkage, "FEW", 10**9)
            want = linkage.matched(x, y)
            monkeypatch.setattr(linkage, "FEW", 0)
            assert linkage.matched(x, y) == want, size


def test_names_that_no_table_holds(spark):
    groups = [
        ["Zbigniew Kowalski", "Zbigniew Kowalsky", "zbigniew kowalski", "Zbigneiw Kowalski", "Kowalski Zbigniew", "Kowalski, Zbigniew", "Z. Kowalski"],
        ["Anna Lee", "anna lee", "Lee, Anna"],
        ["Joachim Lea"],
        ["Zbigniew Nowak", "Zbigniew  Nowak"],
        ["Thaddaeus Maria Otto Karl Emil Fritz Hugo Paul Graf Eulenstein", "THADDAEUS MARIA OTTO KARL EMIL FRITZ HUGO PAUL GRAF EULENSTEIN"],
        ["Bronislaw Nowak"],
    ]
    df = spark.createDataFrame([(n,) for g in groups for n in g], "name string")
    got = {(r.name_a, r.name_b) for r in names.name_pairs(names.linked(df)).collect()}
    assert got == {(a, b) for g in groups for a in g for b in g if a < b}


def test_hopeless_pairs_are_not_matched_word_by_word(monkeypatch):
    same = [f"common{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)]
    a = same + "velvet orchard lantern quarry meadow trumpet harvest pilgrim saddle compass".split() * 3
    b = same + "granite whistle blanket chimney dolphin feather gallery horizon journey kingdom".split() * 3
    assert not linkage.compare(a, b, 60.0)[1]
    called = []
    monkeypatch.setattr(linkage, "matched", lambda *x: called.append(x))
    assert not linkage.compare(a, b, 60.0, whole=False)[1] and not called


def test_unfinished_comparison_decides_alike():
    rng = random.Random(4)
    words = "velvet orchard lantern quarry meadow trumpet harvest pilgrim 17 2040 um so fwd note pkg package mtg meeting compass granite whistle".split()
    slip = lambda w: w[:2] + rng.choice("abcdefgh") + w[3:] if len(w) > 4 and rng.random() < 0.3 else w
    seen = Counter()
    for _ in range(4000):
        a = rng.choices(words, k=rng.randint(3, 40))
        b = [slip(w) for w in a if rng.random() < 0.97] + rng.choices(words, k=rng.choice([0, 0, 1, 3]))
        b = b or a
        whole, short = linkage.compare(a, b, 60.0), linkage.compare(a, b, 60.0, whole=False)
        assert whole[1] == short[1] and (not whole[1] or whole == short)
        seen[whole[1]] += 1
    assert min(seen[True], seen[False]) > 200
