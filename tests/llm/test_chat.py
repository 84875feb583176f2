import hashlib

from tidewatch.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, win string, place string"


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        out[conv] = (len(mine), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def sample():
    rows = [(1, 0, "system", "be <kind> & short", "x", "y"), (1, 1, "user", None, "x", "y"), (1, 2, "assistant", "é<|end|>&lt;", "x", "y")]
    rows += [(2, i, "assistant" if i % 2 else "user", "word " * (i * 37 % 900), "x", "y") for i in range(40)]
    rows += [(3, 0, "assistant", "long " * 3000, "x", "y"), (3, 1, None, "a", "x", "y"), (3, 1, None, "a", "x", "y"), (3, None, "user", "", "x", "y")]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]", "x", "y"), (-7, 1, "assistant", "</s>[INST] ok [/INST]", "x", "y"), (None, 0, "a|b", "t", "x", "y")]
    return rows


def test_round_trip(spark):
    rows = sample()
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(chat.format_windows(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == brute(rows)


def tokens(text):
    return 1 + -(-len(text) // 4)


def turns_of(*parts):
    return [(1, i, role, text, "x", "y") for i, (role, text) in enumerate(parts)]


def test_windows_hold_the_budget(spark):
    cases, rows = {}, []
    for conv, (system, at) in enumerate((s, a) for s in (3, 1000, 1788, 1792, 5000) for a in (0, 1, 7)):
        talk = [("assistant" if i % 2 else "user", f"{i} " + "w " * (300 + i * 97 % 700)) for i in range(60)]
        talk[20:20] = [("assistant", "long " * 600), ("user", "w " * 1900), ("assistant", "huge " * 2000), ("user", "short")]
        mine = turns_of(*talk[:at], ("system", "s" * system), *talk[at:])
        cases[conv] = system, len(mine)
        rows += [(conv, *r[1:]) for r in mine]
    found: dict = {}
    for r in chat.turn_windows(spark.createDataFrame(rows, SCHEMA), 1024, 128).collect():
        found.setdefault(r.conv_id, []).append(r)
    for conv, (system, n) in cases.items():
        holds_budget(found[conv], system, n)


def holds_budget(shown, system, n):
    wins = {}
    for r in shown:
        wins.setdefault(r.win, []).append(r)
    assert sorted(r.place for r in shown if r.kind == 2) == list(range(1, n + 1)) and len(wins) > 20
    held = tokens("s" * system) <= (1024 - 128) // 2
    left_out = 0
    for win, items in wins.items():
        size = lambda *kinds: sum(tokens(r.text) for r in items if r.kind in kinds)  # noqa: E731, B023
        assert size(0, 1, 2) <= 1024 or ([r.kind for r in items] == [2] and size(2) > 1024)
        assert size(1) <= 128
        before = any(r.role == "system" for w in range(win) for r in wins[w] if r.kind == 2)
        repeated = [r for r in items if r.kind == 0]
        if before and held and tokens("s" * system) + size(2) <= 1024:
            assert [r.text for r in repeated] == ["s" * system]
        else:
            left_out += before and held
            assert not repeated
        if win:  # history ends where the window begins, and isn't shorter than it must be
            past = sorted((r for r in wins[win - 1] if r.kind == 2), key=lambda r: r.place)
            if any(r.role == "system" for r in past):
                continue
            got = sorted((r for r in items if r.kind == 1), key=lambda r: r.place)
            assert [r.text for r in got] == [r.text for r in past[len(past) - len(got) :]]
            if len(got) < len(past):
                more = tokens(past[len(past) - len(got) - 1].text)
                assert size(1) + more > 128 or size(0, 1, 2) + more > 1024
    assert left_out <= 3


def test_the_last_system_turn_is_in_force(spark):
    talk = [("assistant" if i % 2 else "user", f"{i} " + "w " * 300) for i in range(40)]
    rows = turns_of(*talk[:10], ("system", "one"), *talk[10:20], ("system", "two"), *talk[20:])
    wins = {}
    for r in chat.turn_windows(spark.createDataFrame(rows, SCHEMA)).collect():
        wins.setdefault(r.win, []).append(r)
    for items in wins.values():
        first = min(r.place for r in items if r.kind == 2)
        assert [r.text for r in items if r.kind == 0] == ([] if first <= 11 else ["one"] if first <= 22 else ["two"])


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert chat.read_back(chat.format_windows(df)).count() == 0
