import pytest

from murmur.llm import queries, quotes

DDL = "conv_id long, turn long, role string, text string, root string, depth string, hash int"


def run(spark, rows):
    return quotes.conversations(spark.createDataFrame([(*r, "r", "d", 1) for r in rows], DDL)).collect()


def test_levels_and_passages():
    own, deepest, passages = quotes.parse("On Monday Ann wrote:\n> one\n>> zero\n> > Zero \nmine\n")
    assert own == "mine" and deepest == 2
    assert {p["level"] for p in passages} == {0, 1, 2}
    assert len({p["hash"] for p in passages if p["level"] == 2}) == 2  # the line, and both lines as a passage
    assert quotes.parse(None) == (None, 0, []) and quotes.parse("") == ("", 0, [])
    assert quotes.level_of("  > > x") == (2, "x") and quotes.level_of("a > b") == (0, "a > b")


def test_replies_trees_and_odd_rows(spark):
    rows = [
        (1, 0, "a", "Hello there\nsecond line"), (1, 1, "b", "> Hello there\n> second line\nsure"), (1, 2, "a", "> second LINE\nother"),
        (1, 3, "b", ">> hello there\n> sure\nfine"), (1, 4, "c", "> never said\nlost"), (1, 5, "c", "sure"), (1, 6, "d", "> sure\nagain"),
        (1, 6, "d", "> sure\nagain"), (2, 0, "a", None), (2, 1, "b", ""), (2, 2, "b", "> sure\nother conversation"), (None, 1, "x", "> Hello there\nq"),
        (3, None, "x", "t"), (4, 0, "a", "w " * 60000), (4, 1, "b", "> " + "w " * 60000 + "\nok"),
    ]
    found = run(spark, rows)
    assert len(found) == len(rows)
    by = {(r.conv_id, r.turn): r for r in found}
    assert [(by[1, t].reply_to, by[1, t].thread, by[1, t].depth) for t in range(7)] == [
        (None, 0, 0), (0, 0, 1), (0, 0, 1), (1, 0, 2), (None, 4, 0), (None, 5, 0), (1, 0, 2)]
    assert by[1, 3].quoted_messages == 2 and by[1, 4].unmatched_levels == 1 and by[1, 3].text == "fine"
    assert by[2, 0].text is None and by[2, 1].text == "" and by[2, 2].reply_to is None
    assert by[4, 1].reply_to == 0 and by[4, 1].text == "ok"
    assert [r.turn for r in found if r.conv_id == 1] == [0, 1, 2, 3, 6, 6, 4, 5]
    assert run(spark, rows[:1])[0].depth == 0
    empty = spark.createDataFrame([], DDL)
    assert quotes.conversations(empty).count() == 0


def test_long_chains(spark):
    rows = [(1, t, "r", (f"> say {t - 1}\n" if t else "") + f"say {t}") for t in range(300)]
    found = run(spark, rows)
    assert [(r.turn, r.depth, r.thread) for r in found] == [(t, t, 0) for t in range(300)]


def brute(rows):
    """The same linking by plain loops."""
    own = {}
    for conv, turn, _, text in sorted(rows):
        for p in quotes.parse(text)[2]:
            if p["level"] == 0:
                own.setdefault((conv, p["hash"]), turn)
    out = {}
    for conv, turn, _, text in rows:
        votes = {}
        for p in quotes.parse(text)[2]:
            at = own.get((conv, p["hash"]))
            if p["level"] == 1 and at is not None and at < turn:
                votes[at] = votes.get(at, 0) + p["chars"]
        out[conv, turn] = max(votes, key=lambda t: (votes[t], t)) if votes else None
    depth, root = {}, {}
    for key in sorted(out):
        up = out[key]
        depth[key] = 0 if up is None else depth[key[0], up] + 1
        root[key] = key[1] if up is None else root[key[0], up]
    return {k: (out[k], root[k], depth[k]) for k in out}


@pytest.fixture(scope="module")
def mails(spark, sf):
    return [tuple(r) for r in quotes.as_mails(spark.read.parquet(f"{sf}/conversations.parquet")).collect()]


def test_query_matches_loops(spark, sf, mails):
    turns = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    found = queries.QUERIES["op1_quotation_linking"](spark, sf).collect()
    assert {(r.conv_id, r.turn): (r.reply_to, r.thread, r.depth) for r in found} == brute(mails)
    assert len(found) == len(turns) and all(r.text == turns[r.conv_id, r.turn].strip() for r in found)
    assert sum(r.reply_to == r.turn - 1 for r in found if r.turn) > 0.9 * sum(r.turn > 0 for r in found)


def test_mails_quote_two_turns_in_one_join_and_little_is_stored(spark, monkeypatch):
    rows = [(1, 0, "one\ntwo"), (1, 1, "three"), (1, 1, "four"), (1, 2, None), (1, 3, "five"), (2, 5, "six"), (None, 0, "x"),
            (None, 1, "y"), (3, None, "z"), (4, 0, None), (4, 1, "a"), (4, 2, "")]
    mails = quotes.as_mails(spark.createDataFrame([(c, t, "r", x, "r", "d", 1) for c, t, x in rows], DDL))
    before = {}
    for c, t, x in rows:
        if c is not None and t is not None and x is not None:
            before[c, t] = min(x, before.get((c, t), x))
    want = []
    for c, t, x in rows:
        parts = [mark + before[c, t - by].replace("\n", "\n" + mark) for by, mark in ((2, ">> "), (1, "> "))
                 if t is not None and (c, t - by) in before]
        want.append((c, t, None if x is None else "\n".join([*parts, x])))
    assert sorted(map(repr, want)) == sorted(repr((r.conv_id, r.turn, r.text)) for r in mails.collect())
    plan = mails._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("Aggregate ") == 1

    stored = []
    monkeypatch.setattr(quotes, "materialise", lambda df, name, keep=quotes.materialise: stored.append(name) or keep(df, name))
    assert len(quotes.conversations(mails).collect()) == len(rows)
    # no message is two replies away from its first, so one round settles them
    assert stored == ["quotes-parsed", "quotes-linked", "quotes-tree"]
