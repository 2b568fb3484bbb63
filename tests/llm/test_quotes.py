from fathomline.llm import quotes as q

MAILS = [
    (1, 0, "user", "Shall we meet on Monday?\nI can do ten.\n\nBring the plans."),
    (1, 1, "assistant", "On Friday, A wrote:\n> Shall we meet on Monday?\n> I can do ten.\n\nTen is fine."),
    (1, 2, "user", "> > Bring the plans.\n> Ten is fine.\n\nI'll bring them."),
    (1, 3, "user", "Something else: lunch is ready"),
    (1, 4, "assistant", ">something ELSE lunch is ready!\n\n\n\nGood."),
    (1, 5, "user", ">> Ten is fine.\nwhat about it"),
    (2, 0, "user", "> Bring the plans.\nWhich plans?"),
    (2, 1, "user", "> never said by anyone\nreally"),
]


def test_links_and_threads(spark):
    df = spark.createDataFrame([(*m, 1) for m in MAILS], "conv_id long, turn long, role string, text string, own int")
    got = {(r.conv_id, r.turn): r for r in q.link_quotes(df).collect()}
    assert len(got) == len(MAILS)
    assert {k: r.parent_turn for k, r in got.items()} == {(1, 0): None, (1, 1): 0, (1, 2): 1, (1, 3): None, (1, 4): 3, (1, 5): 1, (2, 0): None, (2, 1): None}
    assert {k: (r.thread_turn, r.depth) for k, r in got.items() if k[0] == 1} == {(1, 0): (0, 0), (1, 1): (0, 1), (1, 2): (0, 2), (1, 3): (3, 0), (1, 4): (3, 1), (1, 5): (0, 2)}
    assert got[1, 1].text == "Ten is fine." and got[1, 2].text == "I'll bring them." and got[1, 4].text == "Good."
    assert [got[k].n_quotes for k in sorted(got)] == [0, 1, 2, 0, 1, 1, 1, 1]
    assert [got[k].n_linked for k in sorted(got)] == [0, 1, 2, 0, 1, 1, 1, 0]
    assert got[2, 0].source_conv == 1 and got[1, 1].source_conv is None


def test_parse():
    assert q.parse("plain\n\n\n\ntext ") == ("plain\n\n\n\ntext ", [])
    assert q.parse("> a\n>> b\n> c\nd") == ("d", [(1, "a"), (2, "b"), (1, "c")])
    assert q.parse("a > b\n x") == ("a > b\n x", [])
    assert q.parse(">") == ("", [(1, "")])


def test_unquoted_tables_pass_through(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    out = q.link_quotes(df)
    assert out.select("conv_id", "turn", "role", "text").exceptAll(df.select("conv_id", "turn", "role", "text")).isEmpty()
    assert out.count() == df.count() and out.where("thread_turn <> turn").isEmpty()


def test_edges(spark):
    rows = [(1, 0, "a", None), (None, 1, "a", "> x y"), (1, None, None, "> x y"), (1, 1, "b", "x y"), (1, 2, "b", "> x y"), (1, 2, "b", "> x y"), (3, 0, "a", "> " * 400 + "deep"), (4, 0, "u", "> x y\n" * 3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = q.link_quotes(df).collect()
    assert len(got) == len(rows)
    assert [r.parent_turn for r in got if (r.conv_id, r.turn) == (1, 2)] == [1, 1]
    assert q.link_quotes(df.limit(0)).count() == 0
    chain = [(7, n, "u", f"> line number {n - 1}\nline number {n}") for n in range(40)]
    got = q.link_quotes(spark.createDataFrame(chain, "conv_id long, turn long, role string, text string")).collect()
    assert all(r.thread_turn == 0 and r.depth == r.turn for r in got)


def test_short_and_rewrapped_quotes(spark):
    rows = [
        (1, 0, "Can we move it? I need two more days for the plans\nand the drawings. Otherwise fine.\n\nMaybe.\nPlease answer."),
        (1, 1, "> Maybe.\nSure."), (1, 2, "> I need two more\n> days for the plans and the\n> drawings.\nTake them."), (1, 3, "> Sure.\n> more days for\nGood."), (1, 4, "> more days for\nnothing whole is quoted"),
    ]
    df = spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    assert {r.turn: r.parent_turn for r in q.link_quotes(df).collect()} == {0: None, 1: 0, 2: 0, 3: 1, 4: None}


def brute(rows):
    parsed = {(c, t): q.parse(x) for c, t, x in rows}
    out = {}
    for (c, t), (_, blocks) in parsed.items():
        found = []
        for level, block in blocks:
            links = []
            for rank, units in enumerate(q.units(block)):
                for unit in units:
                    holders = [k for k, (body, _) in parsed.items() if any(unit in x for x in q.units(body))]
                    near = [b for a, b in holders if a == c and b < t]
                    far = sorted(a for a, _ in holders if a != c)
                    if near:
                        links.append((0, rank, -max(near), 0))
                    elif far:
                        links.append((1, rank, 0, far[0]))
            if links:
                found.append((level, min(links)))
        levels = [level for level, link in found if link[0] == 0]
        parent = max((-link[2] for level, link in found if link[0] == 0 and level == min(levels)), default=None)
        out[c, t] = (len(found), parent)
    return out


def test_against_brute_force(spark):
    import random

    r = random.Random(8)
    said = [f"Line {k} about {w}." for k in range(12) for w in ("plans", "lunch")] + ["Yes.", "No."]
    rows = []
    for c in range(6):
        for t in range(12):
            lines = []
            for _ in range(r.randint(1, 5)):
                lines.append("> " * r.choice([0, 0, 1, 2]) + r.choice(said))
                if r.random() < 0.3:
                    lines.append("")
            rows.append((c, t, "\n".join(lines)))
    df = spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(x.conv_id, x.turn): (x.n_linked, x.parent_turn) for x in q.link_quotes(df).collect()}
    assert got == brute(rows)
