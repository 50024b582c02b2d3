import random

from hypothesis import given, settings
from hypothesis import strategies as st

from pricelens.llm import decontaminate as D


def distance_in(item, text):
    """Fewest edits between item and any part of text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc ", min_size=1, max_size=90), st.text(alphabet="abc ", max_size=120))
def test_bit_parallel_distance(item, text):
    errors, end = D.best_match(item, text)
    assert errors == distance_in(item, text)
    assert errors == len(item) or any(distance_in(item, text[a:end]) == errors for a in [max(0, end - 2 * len(item))])


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        i = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.4:
            out[i] = rng.choice("abcdefgh ")
        elif kind < 0.7:
            del out[i]
        else:
            out.insert(i, rng.choice("xyz"))
    return "".join(out)


def test_every_passage_within_the_budget_is_found():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(12, 40)))) for i in range(12)]
    m = D.Matcher([(i, D.normal(t)) for i, t in items])
    for trial in range(150):
        i, t = items[rng.randrange(len(items))]
        text = " ".join(rng.choice(words) for _ in range(30)) + " " + edited(rng, t, rng.randint(0, 14)) + " " + " ".join(rng.choice(words) for _ in range(30))
        norm = D.normal(text)
        got = {x[0]: x[1] for x in m.find(text)}
        want = {}
        for k, it in items:
            n = D.normal(it)
            d = distance_in(n, norm)
            if len(n) >= D.MIN_CHARS and d <= int(len(n) * D.ERROR_RATE):
                want[k] = d
        assert got == want, trial


def test_leaks_and_edges(spark):
    item = "The quick brown fox jumps over the lazy dog, and then it sleeps under a tall green tree."
    bench = spark.createDataFrame([(1, item), (2, item), (3, "short one"), (4, None), (None, item), (5, "...")], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, f"Before. {item.upper()} After", "m"), (2, "the quick brown fox jumps over", "m"), (3, None, "m"), (4, "", "m"),
        (5, "Short ONE!", "m"), (6, "a short one here", "m"), (None, item, "m"), (7, "filler words here " * 60_000 + item.replace("lazy", "lzy")[:], "m"),
        (1, f"Before. {item.upper()} After", "m"), (8, item.replace("\n", " ").replace(" ", "\n\t "), "m")], "doc_id long, text string, matches string")
    for block in (10, 1_000_000):
        got = sorted((r.doc_id, r.item_id, r.errors) for r in D.leaks(docs.where("doc_id IS NOT NULL"), bench, block_chars=block).collect())
        assert got == [(1, 1, 0), (1, 1, 0), (1, 2, 0), (1, 2, 0), (5, 3, 0), (7, 1, 1), (7, 2, 1), (8, 1, 0), (8, 2, 0)]
    kept = D.decontaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6]
    assert D.leaks(docs, bench.limit(0)).count() == 0 and D.leaks(docs.limit(0), bench).count() == 0


def test_span_of_the_match(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    (m,) = D.Matcher([(1, item)]).find(f"one two {item} three")
    assert m == (1, 0, 8, 8 + len(item))


def test_short_items_inside_longer_texts(spark):
    items = [(1, "What is the capital of Peru?"), (2, "what is the CAPITAL of peru"), (3, "two words"), (4, "is the capital"), (5, "once more with feeling, he said: once more")]
    m = D.Matcher([(i, D.normal(t)) for i, t in items])
    assert m.find("He asked: What is the capital of Peru? Lima.") == [(1, 0, 9, 36), (2, 0, 9, 36), (4, 0, 14, 28)]
    assert m.find("what is the capital of peru") == [(1, 0, 0, 27), (2, 0, 0, 27), (4, 0, 5, 19)]
    assert m.find("somewhat is the capital of Perugia, this the capitals") == [(4, 0, 9, 23)]
    assert m.find("this the capitals; is the capitals; is the capital") == [(4, 0, 34, 48)]
    assert m.find("two words here") == [] and m.find("Two words!") == [(3, 0, 0, 9)]
    bench = spark.createDataFrame([(1, items[0][1])], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " * 50_000 + items[0][1] + " y"), (2, "What is the capital of Perugia?")], "doc_id long, text string")
    assert [(r.doc_id, r.errors) for r in D.leaks(docs, bench).collect()] == [(1, 0)]
    assert [r.doc_id for r in D.decontaminated(docs, bench).collect()] == [2]


def test_many_blocks_are_one_stage(spark):
    words = [f"w{i * 7919 % 997}" for i in range(4000)]
    items = [(f"q-{i}", " ".join(words[i * 13:i * 13 + 12])) for i in range(200)] + [("q-0", " ".join(words[:12]))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = spark.createDataFrame([(i, f"start {' '.join(words[i * 13:i * 13 + 12])} end", "b", 1) for i in range(0, 200, 3)] + [(-1, "clean words only", "b", 1)], "doc_id long, text string, block string, id int")
    many = D.matches(docs, bench, block_chars=300)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    got = {r.doc_id: [m.item_id for m in r.matches] for r in many.collect()}
    assert got == {r.doc_id: [m.item_id for m in r.matches] for r in D.matches(docs, bench).collect()}
    assert got[-1] == [] and got[0].count("q-0") == 2 and all(f"q-{i}" in got[i] for i in range(0, 200, 3))
    assert many.columns == [*docs.columns, "matches"]
