import random
import re
from itertools import groupby

from playlytics.llm import chat
from playlytics.llm.queries import op10_chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def norm(text):
    return " ".join(w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.lower()) if w)


def own_lines(text):
    lines = (text or "").split("\n")
    quoted = lambda line: re.match(r"\s*>", line)
    return [
        line
        for i, line in enumerate(lines)
        if not quoted(line) and not (re.search(r"(wrote|writes|said)\s*:\s*$", line) and i + 1 < len(lines) and quoted(lines[i + 1]))
    ]


def brute(rows):
    """(thread, depth, reply) of each (conversation, turn)."""
    stated, replies = {}, {}
    for conv, turn, _, text in sorted(rows, key=lambda r: r[1]):
        own = "\n".join(own_lines(text)).strip()
        for unit in [own, *re.split(r"\n\s*\n", own), *own.split("\n")]:
            stated.setdefault((conv, norm(unit)), turn)
    for conv, turn, _, text in rows:
        passages, last = [], None
        for i, line in enumerate((text or "").split("\n")):
            marks = re.match(r"(\s*>)+", line)
            if marks:
                level, rest = marks[0].count(">"), line[marks.end() :]
                if last == (i - 1, level):
                    passages[-1][1].append(rest)
                else:
                    passages.append((level, [rest]))
                last = (i, level)
        paragraphs = lambda lines: [" ".join(x) for k, x in groupby(lines, key=lambda line: norm(line) != "") if k]
        units = {(level, norm(x)) for level, lines in passages for x in [" ".join(lines), *paragraphs(lines), *lines]}
        votes = {}
        for level, unit in units:
            first = stated.get((conv, unit))
            if unit and first is not None and first < turn:
                votes[(level, first)] = votes.get((level, first), 0) + len(unit.split())
        if votes:
            replies[(conv, turn)] = min((level, -words, -first) for (level, first), words in votes.items())[2] * -1
    out = {}
    for conv, turn, _, _ in rows:
        at, depth = turn, 0
        while (conv, at) in replies:
            at, depth = replies[(conv, at)], depth + 1
        out[(conv, turn)] = (at, depth, replies.get((conv, turn)))
    return out


def conversation(conv, n, rng):
    said, rows = [], []
    for turn in range(n):
        lines = []
        if said and rng.random() < 0.7:
            source = rng.choice(said)
            part = source[: rng.randint(1, len(source))]
            if rng.random() < 0.4:
                lines.append("On Monday someone wrote:")
            level = ">" * rng.choice((1, 1, 2))
            lines += [f"{level} {x}" for x in part]
            if rng.random() < 0.3:
                lines += [f"> > {x}" for x in rng.choice(said)]
        own = [" ".join(rng.choice("red blue green one two six".split()) for _ in range(rng.randint(1, 6))) + "." for _ in range(rng.randint(1, 3))]
        if rng.random() < 0.2:
            own.append(rng.choice(rng.choice(said)) if said else "same words")
        said.append(own)
        rows.append((conv, turn, rng.choice(("user", "assistant")), "\n".join([*lines, *own])))
    return rows


def test_against_brute_force(spark):
    rng = random.Random(6)
    rows = [r for conv in range(30) for r in conversation(conv, rng.randint(1, 14), rng)]
    rng.shuffle(rows)
    got = chat.format_chats(spark.createDataFrame([(*r, "x") for r in rows], f"{SCHEMA}, thread string")).collect()
    want = brute(rows)
    assert {(r["conv_id"], r["turn"]): (r["thread"], r["depth"], r["reply_to"]) for r in got} == want
    assert max(d for _, d, _ in want.values()) >= 3
    texts = {(c, t): "\n".join(own_lines(x)).strip() for c, t, _, x in rows}
    assert {(r["conv_id"], r["turn"]): r["text"] for r in got} == texts
    assert [(r["conv_id"], r["thread"], r["turn"]) for r in got] == sorted((c, want[(c, t)][0], t) for c, t, _, _ in rows)


def test_long_chain_of_replies(spark):
    rows = [(1, 0, "user", "line 0")] + [(1, k, "user", f"> line {k - 1}\nline {k}") for k in range(1, 70)]
    got = {r["turn"]: (r["thread"], r["depth"], r["reply_to"]) for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: (0, 0, None), **{k: (0, k, k - 1) for k in range(1, 70)}}


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", "hello there"),
        (1, 1, None, "> Hello, there!\n>> nothing\nyes"),
        (1, 1, None, "> Hello, there!\n>> nothing\nyes"),
        (2, 0, "user", "> hello there\nfrom nowhere"),
        (None, 0, "user", "> hello there"),
        (1, None, "user", "hello there"),
        (1, 3, "user", None),
        (1, 4, "user", ""),
        (1, 5, "user", ">"),
        (1, 6, "user", "> > > hello there"),
    ]
    got = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    found = [(r["conv_id"], r["turn"], r["reply_to"], r["text"]) for r in got]
    assert found.count((1, 1, 0, "yes")) == 2
    assert (2, 0, None, "from nowhere") in found and (None, 0, None, "") in found and (1, 3, None, "") in found
    assert (1, 6, 0, "") in found
    assert any(r["formatted"] == "<|user|>\nhello there\n<|end|>" for r in got)
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_is_native_and_keeps_every_message(spark, folder):
    frame = op10_chat(spark, folder)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute(rows)
    assert {(r["conv_id"], r["turn"]): (r["thread"], r["depth"], r["reply_to"]) for r in frame.collect()} == want


def test_sql_on_quoting_conversations(spark, tmp_path):
    """The tables hold few quotes, so the SQL is compared on conversations that do."""
    import duckdb

    from playlytics.llm.oracles import CHAT

    rng = random.Random(8)
    rows = [r for conv in range(25) for r in conversation(conv, rng.randint(1, 12), rng)]
    rows += [(None, 1, "user", "> x"), (3, None, None, "a\n\n"), (4, 99, None, None), (4, 99, None, None)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    cursor = con.execute(CHAT)
    names = [d[0] for d in cursor.description]
    want = sorted((repr([row[names.index(c)] for c in sorted(names)]) for row in cursor.fetchall()))
    frame = op10_chat(spark, str(tmp_path))
    assert sorted(frame.columns) == sorted(names)
    assert sorted(repr([r[c] for c in sorted(names)]) for r in frame.collect()) == want


def paragraphed(conv, n, rng):
    """Messages of several paragraphs; replies quote some of them, wrapped anew."""
    said, rows = [], []
    for turn in range(n):
        lines = []
        if said and rng.random() < 0.8:
            source = rng.choice(said)
            first = rng.randrange(len(source))
            for k, paragraph in enumerate(source[first : first + rng.randint(1, 2)]):
                words = paragraph.split()
                cut = rng.randint(1, len(words))
                lines += [">"] * (k > 0) + [f"> {' '.join(x)}" for x in (words[:cut], words[cut:]) if x]
        own = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(4, 9))) + "." for _ in range(rng.randint(1, 4))]
        said.append(own)
        rows.append((conv, turn, "user", "\n".join([*lines, "\n\n".join(own)])))
    return rows


def test_paragraphs_wrapped_anew_against_brute_force_and_sql(spark, tmp_path):
    import duckdb

    from playlytics.llm.oracles import CHAT

    rng = random.Random(8)
    rows = [r for conv in range(25) for r in paragraphed(conv, rng.randint(2, 10), rng)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = chat.format_chats(frame)
    want = brute(rows)
    assert {(r["conv_id"], r["turn"]): (r["thread"], r["depth"], r["reply_to"]) for r in got.collect()} == want
    # nearly every quoting message is linked
    quoting = [(c, t) for c, t, _, x in rows if ">" in x]
    assert sum(want[k][2] is not None for k in quoting) >= 0.95 * len(quoting) > 20
    frame.coalesce(1).write.parquet(f"{tmp_path}/conversations")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations/*.parquet')")
    cursor = con.execute(CHAT)
    names = [d[0] for d in cursor.description]
    key = lambda r: tuple(map(str, r))
    assert sorted(cursor.fetchall(), key=key) == sorted(map(tuple, got.select(names).collect()), key=key)


def test_two_of_three_paragraphs(spark):
    text = "The first paragraph has\nsome words.\n\nThe second one is long enough to be\nbroken anew.\n\nA third."
    reply = "> The second one is long\n> enough to be broken anew.\n>\n> A third.\n\nYes."
    got = chat.format_chats(spark.createDataFrame([(1, 1, "user", text), (1, 2, "user", reply)], SCHEMA)).collect()
    assert [r["reply_to"] for r in got] == [None, 1]
