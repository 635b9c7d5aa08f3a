import random
from collections import Counter, defaultdict

import regex
from pyspark.sql import functions as F

from loomspan.llm import quotes

MESSAGES = "conv_id bigint, turn bigint, role string, text string"
ROWS = [
    (1, 0, "user", "Hello all.\nHow do I cut a shard evenly? I tried it twice."),
    (1, 1, "assistant", "On Monday, X wrote:\n> Hello all.\n> How do I cut a shard\n> evenly? I tried it twice.\n\nUse prefix sums. They are exact."),
    (1, 2, "user", ">> How do I cut a shard evenly?\n> Use prefix sums.\nThanks!"),
    (1, 3, "assistant", "> HOW do I cut: a shard evenly\nAnother idea: hash it."),
    (1, 4, "user", "ok"),
    (1, 5, "user", "> nobody said this at all\nbut I answer"),
    (2, 7, "user", "plain > not a quote"),
    (2, 7, "user", "plain > not a quote"),
    (2, None, None, None),
    (None, 1, "user", "> x\nbody"),
    (3, 5, "user", ""),
    (3, 2000, "user", "far later"),
]


def out(spark, rows):
    df = spark.createDataFrame(rows, MESSAGES).withColumn("range", F.lit(1)).withColumn("branch", F.lit("x")).withColumn("body", F.lit("x"))
    return quotes.reply_ordered(df.repartition(3)).collect()


def test_replies_branches_and_bodies(spark):
    got = {(r.conv_id, r.turn): (r.parent_turn, r.branch, r.place, r.linked, r.body) for r in out(spark, ROWS)}
    assert got[1, 0] == (None, 0, 0, False, "Hello all.\nHow do I cut a shard evenly? I tried it twice.")
    assert got[1, 1] == (0, 0, 1, True, "Use prefix sums. They are exact.")
    assert got[1, 2] == (1, 0, 2, True, "Thanks!")  # the outermost level decides
    assert got[1, 3] == (0, 1, 0, True, "Another idea: hash it.")
    assert got[1, 4] == (3, 1, 1, False, "ok")
    assert got[1, 5] == (4, 1, 2, False, "but I answer")
    assert got[2, 7] == (None, 0, 0, False, "plain > not a quote")
    assert got[2, None] == (None, 0, 0, False, "") and got[None, 1] == (None, 0, 0, False, "body")
    assert got[3, 2000] == (5, 0, 1, False, "far later")
    assert len(out(spark, ROWS)) == len(ROWS)


def test_long_conversations_are_ranked_over_ranges(spark):
    rows = [(9, t, "user", f"message number {t} says something new" if t % 500 else f"> message number {t // 2} says something new\nno") for t in range(2600)]
    got = {r.turn: r for r in out(spark, rows)}
    parents, branch, place = {}, 0, 0
    for t in range(2600):
        origin = t // 2 if t % 500 == 0 and t and (t // 2) % 500 else None
        parents[t] = origin if origin is not None else (t - 1 if t else None)
        branch, place = (branch + 1, 0) if t and parents[t] != t - 1 else (branch, place + 1 if t else 0)
        assert (got[t].parent_turn, got[t].branch, got[t].place) == (parents[t], branch, place)


def test_lines_and_runs_of_lines_are_found(spark):
    listed = "buy two apples\nbuy three oranges\nbuy some pears\nno"
    quotes_of = [
        "> buy three oranges\nno", "> buy two apples\n> buy three oranges\nno", "> buy three oranges buy some\n> pears\nyes", "> see this\n> buy two\n> apples\nyes",
        "> he said\n> buy three oranges buy\n> some pears\n> right?\nyes", "> buy three\n> oranges buy some pears\n> no\nyes", "> no\nshort",
    ]
    rows = [(c, t, "user", x) for c, q in enumerate(quotes_of) for t, x in enumerate([listed, "anything else", q])]
    rows += [(50, 0, "user", listed), (50, 1, "user", "else"), (50, 2, "user", "> buy three pears\nno"), (51, 0, "user", "one\n\n> x y z\ntwo"), (51, 1, "user", "else"), (51, 2, "user", "> one two\nno")]
    got = {(r.conv_id, r.turn): (r.parent_turn, r.linked) for r in out(spark, rows)}
    assert [got[c, 2] for c in range(len(quotes_of))] == [(0, True)] * len(quotes_of)
    assert got[50, 2] == (1, False) and got[51, 2] == (1, False)


def test_long_lists_are_found_wrapped_in_another_way(spark):
    words = [f"w{i}" for i in range(900)]
    listed = "\n".join(" ".join(words[i : i + 3]) for i in range(0, 900, 3))
    quote = "> intro\n" + "\n".join("> " + " ".join(words[i : i + 7]) for i in range(300, 300 + 7 * 60, 7))
    got = {r.turn: r.parent_turn for r in out(spark, [(1, 0, "user", listed), (1, 1, "user", "else"), (1, 2, "user", quote)])}
    assert got == {0: None, 1: 0, 2: 0}


def test_empty_table(spark):
    assert out(spark, []) == []


def normalised(text):
    return regex.sub(r"[^\p{L}\p{N}]+", " ", text.lower()).strip(" ")


def passages(text):
    """(level, text) of the runs of lines of one level, by a loop over lines."""
    lines = []
    for x in (text or "").split("\n"):
        mark = regex.match(r"(?:[ \t]*>)*", x).group()
        lines.append((mark.count(">"), regex.sub(r"^[ \t]?", "", x[len(mark) :]) if mark else x))
    kept = [p for p, after in zip(lines, [*lines[1:], (0, "")]) if not (p[1].endswith(" wrote:") and after[0] > p[0])]
    out = []
    for level, line in kept:
        if out and out[-1][0] == level:
            out[-1][1].append(line)
        else:
            out.append((level, [line]))
    return [(level, "\n".join(ls)) for level, ls in out]


def all_units(text):
    lines = [n for n in map(normalised, text.split("\n")) if n]
    runs = {" ".join(lines[a:b]) for a in range(len(lines)) for b in range(a + 2, len(lines) + 1)}
    sentences = set(map(normalised, regex.split(r"(?<=[.!?])\s+|\n\s*\n", text)))
    long = {u for u in runs | sentences if len(u.split()) >= quotes.UNIT_WORDS}
    return (long | set(lines) | {normalised(text)}) - {""}


def brute_force(rows):
    """(conv_id, turn): parent_turn, branch, place, linked."""
    talks = defaultdict(lambda: defaultdict(list))
    for conv, turn, _, text in rows:
        talks[conv][turn] += passages(text)
    want = {}
    for conv, turns in talks.items():
        first, branch, place, previous = {}, 0, -1, None
        for t in sorted(turns):
            for u in {u for level, p in turns[t] if not level for u in all_units(p)}:
                first.setdefault(u, t)
        for t in sorted(turns):
            asked = {(level, u) for level, p in turns[t] if level for u in all_units(p)}
            votes = Counter((level, first[u]) for level, u in asked if first.get(u, t) < t)
            origin = min(votes, key=lambda v: (v[0], -votes[v], -v[1]))[1] if votes else None
            parent = previous if origin is None else origin
            branch, place = (branch + 1, 0) if parent != previous else (branch, place + 1)
            want[conv, t] = (parent, branch, place, origin is not None)
            previous = t
    return want


def test_links_and_order_equal_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(30)]
    rows, written = [], defaultdict(list)
    for conv in range(40):
        for turn in range(rng.randrange(2, 14)):
            lines = []
            for _ in range(rng.randrange(0, 4)):
                if written[conv] and rng.random() < 0.7:
                    source = rng.choice(written[conv]).split("\n")
                    a = rng.randrange(len(source))
                    words = " ".join(source[a : a + rng.randrange(1, 4)]).split()
                    step, level = rng.randrange(2, 8), rng.choice(["> ", ">", ">> ", "> > "])
                    lines += [rng.choice(["X wrote:", "see:"])] if rng.random() < 0.3 else []
                    lines += [level + " ".join(words[i : i + step]).upper() for i in range(0, len(words), step)]
                else:
                    lines += ["> " + " ".join(rng.choices(vocabulary, k=rng.randrange(1, 4)))] * (rng.random() < 0.3)
            own = "\n".join("".join(w + rng.choice([" "] * 6 + [". ", ", "]) for w in rng.choices(vocabulary, k=rng.randrange(1, 6))) for _ in range(rng.randrange(1, 5)))
            written[conv].append(own)
            rows.append((conv, turn * 3, "user", "\n".join([*lines, own] if rng.random() < 0.8 else [own, *lines])))
            if rng.random() < 0.05:
                rows.append(rows[-1])
    want = brute_force(rows)
    assert sum(w[3] for w in want.values()) > 60 and sum(w[1] > 0 for w in want.values()) > 60
    assert {(r.conv_id, r.turn): (r.parent_turn, r.branch, r.place, r.linked) for r in out(spark, rows)} == want
