import random

from pricelens.llm import preference as P


def render(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def clean(s, default=""):
    return (default if s is None else s).replace("<|", "< |")


def spans(turns):
    out, at = [], 0
    for r, t in turns:
        n = len(render([(r, t)]))
        if r == "assistant":
            out.append((at + len(r) + 5, at + n - 1))
        at += n
    return out


def brute(chosen, rejected):
    sides = []
    for rows in (chosen, rejected):
        by = {}
        for p, turn, role, text in rows:
            if p is not None and turn is not None:
                by.setdefault(p, set()).add((turn, clean(role, "unknown"), clean(text)))
        sides.append({p: [x[1:] for x in sorted(v)] for p, v in by.items()})
    out = {}
    for p in sides[0].keys() & sides[1].keys():
        c, r = sides[0][p], sides[1][p]
        n = next((i for i in range(max(len(c), len(r))) if c[i:i + 1] != r[i:i + 1]), len(c))
        out[p] = (n, render(c[:n]), render(c[n:]), render(r[n:]), spans(c[n:]), spans(r[n:]), bool(spans(c[n:]) and spans(r[n:])))
    return out


def check(spark, chosen, rejected):
    schema = "pair_id long, turn long, role string, text string, prompt string"
    a, b = (spark.createDataFrame([(*r, "x") for r in rows], schema) for rows in (chosen, rejected))
    got = {r.pair_id: (r.n_common, r.prompt, r.chosen, r.rejected, [tuple(x) for x in r.chosen_mask], [tuple(x) for x in r.rejected_mask], r.usable) for r in P.format_pairs(a, b).collect()}
    assert got == brute(chosen, rejected)
    return got


def test_random_conversations(spark):
    rng = random.Random(2)
    sides = ([], [])
    for p in range(60):
        base = [(p, i, "assistant" if i % 2 else "user", rng.choice(["a", "b\nc", "", None, "é<|end|>x"])) for i in range(rng.randint(0, 6))]
        for s in sides:
            s += base[:rng.randint(0, len(base))] + [(p, 10 + i, rng.choice(["assistant", "user", None]), rng.choice("xyz")) for i in range(rng.randint(0, 2))]
    check(spark, *sides)


def test_edges(spark):
    a = [(1, 0, "user", "q"), (1, 1, "assistant", "good"), (1, 1, "assistant", "good"), (2, 0, "user", "q"), (None, 0, "user", "q"), (3, None, "user", "q"), (4, 0, "user", "q"), (4, 1, "assistant", "x" * 300_000)]
    b = [(1, 0, "user", "q"), (1, 1, "assistant", "bad"), (2, 0, "user", "q"), (4, 0, "user", "q"), (4, 1, "assistant", "y"), (5, 0, "user", "only here")]
    got = check(spark, a, b)
    assert set(got) == {1, 2, 4} and got[1][1] == "<|user|>\nq<|end|>\n" and got[1][6] and not got[2][6]
    text, (start, end) = got[1][2], got[1][4][0]
    assert text[start:end] == "good<|end|>"
    assert check(spark, [], []) == {}


def test_neighbour_pairs(spark):
    """Every conversation with an assistant turn has a pair; splits vary, completions have several turns."""
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 40, 3), 41, 42, -7, -8]:
        rows += [(c, t, "assistant" if t % 2 else "user", rng.choice([f"t{c}.{t}", "same", None])) for t in range(rng.randint(1, 9))]
    rows += [(100, 0, "user", "no answer"), (None, 1, "assistant", "x"), (7, None, "assistant", "x"), (0, 1, "assistant", "again"), rows[0]]
    d = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, split string").repartition(4)
    named = [(c, t, r, x or "") for c, t, r, x in rows if c is not None and t is not None]
    last = {c: max((t, x) for d_, t, r, x in named if d_ == c and r == "assistant") for c in {c for c, _, r, _ in named if r == "assistant"}}
    ring = sorted(last)
    chosen, rejected = [], []
    for c, t, r, x in named:
        if c in last and t <= last[c][0]:
            at = sorted({u for e, u, q, _ in named if e == c and q == "assistant"})
            swap = r == "assistant" and t >= at[c % len(at)]
            chosen.append((c, t, r, x))
            rejected.append((c, t, r, last[ring[(ring.index(c) + 1) % len(ring)]][1] if swap else x))
    got = {r.pair_id: (r.n_common, r.prompt, r.chosen, r.rejected, [tuple(x) for x in r.chosen_mask], [tuple(x) for x in r.rejected_mask], r.usable) for r in P.format_pairs(*P.neighbour_pairs(d)).collect()}
    assert set(got) == set(last) and got == brute(chosen, rejected)
    assert {g[0] for g in got.values()} > {1, 3} and max(len(g[4]) for g in got.values()) > 2
    alone = d.where("conv_id = 42")
    assert P.format_pairs(*P.neighbour_pairs(alone)).count() == (42 in last)
    assert P.format_pairs(*P.neighbour_pairs(d.where("conv_id = 100"))).count() == 0


def test_native_plan(spark):
    d = spark.createDataFrame([(1, 0, "user", "q")], "pair_id long, turn long, role string, text string")
    plan = P.format_pairs(d, d)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
