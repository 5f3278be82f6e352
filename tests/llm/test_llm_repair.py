"""Conversation repair against a plain search over whole audits, and against the contract spelt out in Python."""

import hashlib
import itertools
import re
import zlib

import pytest

from ebbtide.llm import repair

GRAMMAR = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def plain_audit(letters):
    """(cost, edits): every table entry holds the whole audit of an ending, compared as text."""
    ends = {"": (0, ""), "a": (0, ""), "s": (4, "II"), "u": (2, "I")}
    for letter in reversed(letters):
        now = {}
        for state, steps in GRAMMAR.items():
            options = [(3 + ends[state][0], "D" + ends[state][1])]
            for role, to in steps.items() if letter != "x" else ():
                extra = letter.isupper()
                if role == letter.lower():
                    options.append((extra + ends[to][0], "K" + ends[to][1]))
                if role != "s":
                    options.append((2 + extra + ends[to][0], "R" + ends[to][1]))
            now[state] = min(options)
        for _ in GRAMMAR:
            for state, steps in GRAMMAR.items():
                for role, to in steps.items():
                    if role != "s":
                        now[state] = min(now[state], (2 + now[to][0], "I" + now[to][1]))
        ends = now
    return ends[""]


def plain(rows):
    """The contract, conversation by conversation."""
    def said(value):
        return " " if value is None else str(value)

    conversations = {}
    for conv, turn, role, text in rows:
        mine = conversations.setdefault(conv, [])
        fate = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        mine += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    found = {}
    for conv, mine in conversations.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(f"{len(r[1])}\n{r[1]}\n{r[2]}".encode()).digest()))
        seen, faults, letters = set(), [], ""
        for _, role, text in mine:
            core = re.sub(r"[\x20\x09-\x0d]+\Z", "", text)
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
            seen.add((role, text))
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            letters += {"blank": "x", "duplicate": "x", "truncated": initial.upper(), "": initial}[faults[-1]]
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit = plain_audit(letters)
        rest, out = iter(mine), []
        for edit in audit:
            row = None if edit == "I" else next(rest)
            if edit == "K":
                out.append((row[1], row[2]))
            elif edit != "D":
                out.append(("assistant" if out and out[-1][0][:1] == "u" else "user", row[2] if row else ""))
        digest = hashlib.sha256("\n".join(map(":".join, out)).encode()).hexdigest()
        found[conv] = (gaps, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return found


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired(frame):
    rows = repair.audited(frame).collect()
    found = {r["conv_id"]: tuple(r[n] for n in NAMES) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("length", range(5))
def test_audits_are_the_cheapest_and_least(length):
    letters = ["".join(x) for x in itertools.product("suaoSUAOx", repeat=length)]
    for order in (letters, sorted(letters, key=lambda s: s[::-1])):
        assert [(c, a) for a, c in repair.audits(order)] == [plain_audit(s) for s in order]


def test_equal_endings_are_one_node():
    walk = repair.Walk()
    for start in ("sua", "ua", "xua", "Oua", "aaa"):
        walk.audit(start + "ua" * 500)
    entries = len(walk.automaton.costs)
    walk.audit("u" + "ua" * 500)
    assert entries < 60 and len(walk.automaton.costs) <= entries + 1


def test_long_signatures_take_linear_time():
    signature = "suuxaAoU" * 50_000
    audit, cost = repair.audits([signature])[0]
    assert cost > 0 and len(audit.replace("I", "")) == len(signature)


def test_query_matches_the_contract(spark, sf):
    frame = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in frame.collect()]
    assert repaired(frame) == plain(rows)


def odd_conversations():
    long = "word " * 40_000
    return [
        (None, None, None, None), (None, 3, "user", "Hi."), (None, 4, "assistant", "Yes!"), (1, None, "user", "No end"),
        (1, None, "user", "No end"), (1, 7, "", "x."), (1, 7, "tool", "é🎉"), (1, 9, "assistant", long), (1, 9, "assistant", long + "."),
        (1, 12, "system", "late."), (2, None, "user", " \t\n"), (3, 0, "system", "Only."), (4, 0, "user", "Q?"), (4, 0, "user", "Q?"),
        *[(5, t, ("user", "assistant", "User")[t % 3], f"turn {t // 4}" + "."[: t % 2]) for t in range(90)],
        *[(6, t, "user", "same.") for t in range(50)], *[(7, t, "assistant", None) for t in range(30)],
        *[(c, 0, "user", "Q?") for c in range(100, 160)],
    ]


def test_odd_rows(spark):
    rows = odd_conversations()
    names = "pos long, conv_id long, turn long, role string, text string, copies string, copy long, row long, fault string, c string, edit string"
    frame = spark.createDataFrame([(1, c, t, r, x, "y", 2, 3, "z", "c", "e") for c, t, r, x in rows], names).repartition(5)
    assert repaired(frame) == plain(rows)
    assert repair.audited(frame.limit(0)).collect() == []


def test_rows_after_repair(spark):
    said = [(1, 0, "user", "Hello there.", 1), (1, 1, "user", "Anybody", 1), (1, 2, "assistant", "Yes.", 1), (2, 0, "user", "dropped", 0)]
    frame = spark.createDataFrame(said, "conv_id long, turn long, role string, text string, copies int")
    found, rows = repair.repair(frame)
    audits = {r["conv_id"]: (r["audit"], r["cost"], r["illegal"], r["truncated"]) for r in found.collect()}
    assert audits[1] == (*plain_audit("uUa")[::-1], 1, 1) and audits[2] == ("", 0, 0, 0)
    texts = [(r["role"], r["text"]) for r in sorted(rows.collect(), key=lambda r: r["position"])]
    assert [r[:1] for r, _ in texts] == list("ua" * (len(texts) // 2)) and ("assistant", "Yes.") in texts
