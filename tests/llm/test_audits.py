"""Filter audit, conversation repair and frequent lines against plain versions."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import clashing, documents

from tidemark.llm import conversations, filter_audit, frequent_lines
from tidemark.llm.dawg import END, Automaton, continued, replay
from tidemark.llm.perfect_hash import PerfectHash

BLANK = " \t\n\x0b\x0c\r"


# 11, filter audit


def plain_audit(rows, labels):
    """Every order applied left to right, document by document."""
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1} - {None} for k in (0, 1))
    lowest: dict = {}
    for i, text, _ in rows:
        if i is not None:
            lowest[text or ""] = min(lowest.get(text or "", i), i)
    docs = []
    for i, text, source in rows:
        text = text or ""
        words = [w for w in "".join(" " if c in BLANK else c for c in text).split(" ") if w]
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and i > lowest[text],
        }
        docs.append((source or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                redundant = sum(letter in d[1] for d in own) - len(gone)
                unique = sum(d[1] == {letter} for d in own)
                shapley[letter] += len(gone)
                out[part, order, step] = [len(left), len(gone), redundant, unique, sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, n int, mask string").repartition(3)
    marks = spark.createDataFrame([(*r, "y") for r in labels], "doc_id long, quality int, toxic int, n string")
    got = filter_audit.interactions(docs, marks).collect()
    return {tuple(r[:3]): list(r[3:]) for r in got}


def test_audit_equals_every_order_applied(spark):
    own = random.Random(5)
    long = [" ".join(own.choice(["alpha", "Beta", "gam", "d%", f"w{k}"]) for k in range(n)) for n in (10, 150, 250, 400, 400, 3000)]
    texts = [None, "", "", *long, long[2], long[2], long[3], " \t\n", "É" * 60, "AB", "x\x85y"]
    rows = [(k, t, own.choice(["s", "t", None, ""])) for k, t in enumerate(texts)]
    rows += [rows[4], (rows[4][0], rows[4][1], "t"), (None, long[2], "s"), (None, "alone", "u"), (-1, long[3], "u")]
    labels = [(k, own.randrange(2), own.randrange(2)) for k in range(0, len(texts), 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1), (4, None, None), (999, 1, 1)]
    assert audited(spark, rows, labels) == plain_audit(rows, labels)


def test_audit_of_tables_without_rows(spark):
    assert audited(spark, [], [(1, 1, 1)]) == {}
    assert audited(spark, [(1, "a", "s")], []) == plain_audit([(1, "a", "s")], [])


# 12, conversation repair


def cheapest(signature):
    """All edit strings with at most two inserts in a place: the cheapest, ties by bytes."""
    kept = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}
    after = [2, 2, 3, 2]
    found = []

    def walk(i, q, cost, edits, inserts):
        if i == len(signature) and q in (0, 3):
            found.append((cost, edits))
        if inserts < 2:
            walk(i, after[q], cost + 3, edits + "I", inserts + 1)
        if i < len(signature):
            symbol = signature[i]
            extra = 3 if symbol.isupper() else 0
            walk(i + 1, q, cost + 4, edits + "D", 0)
            if symbol != "X":
                walk(i + 1, after[q], cost + 3 + extra, edits + "R", 0)
                if (symbol.lower(), q) in kept:
                    walk(i + 1, kept[symbol.lower(), q], cost + extra, edits + "K", 0)

    walk(0, 0, 0, "", 0)
    return min(found)


@pytest.mark.parametrize("length", range(4))
def test_edits_equal_all_edit_strings(length):
    automaton = Automaton()
    for symbols in itertools.product("suaoXUAS", repeat=length):
        signature = "".join(symbols)
        node = automaton.add(signature)
        assert (automaton.costs(node)[0], automaton.audit(node, 0)[0]) == cheapest(signature), signature
    assert len(automaton.best) == 1 + sum(8**k for k in range(1, length + 1))


def test_edits_of_parts_are_those_of_the_whole():
    own = random.Random(2)
    for _ in range(300):
        signature = "".join(own.choice("suaoXUA") for _ in range(own.randrange(2, 30)))
        cut = own.randrange(1, len(signature))
        whole, tail = Automaton(), Automaton()
        last = tail.add(signature[cut:])
        head = Automaton(continued(tail.costs(last)))
        edits, state = head.audit(head.add(signature[:cut]), 0)
        node = whole.add(signature)
        assert edits + tail.audit(last, state)[0] == whole.audit(node, 0)[0]
        roles = ["r"] * len(signature)
        assert replay(signature, whole.audit(node, 0)[0], 0, roles, roles)[0] == whole.costs(node)[0]
    assert [cost for cost, _ in END] == [0, 6, 3, 0]


def plain_repair(rows):
    convs: dict = defaultdict(list)
    for conv, turn, role, text in rows:
        place = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(place.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        convs[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        count, signature, seen, kept = Counter(), "", set(), []
        for _, role, text in own:
            core = text.strip(BLANK)
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
            seen.add((role, text))
            count[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            signature += "X" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
            kept += [] if fault in ("blank", "duplicate") else [(role, text)]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        automaton = Automaton()
        node = automaton.add(signature)
        audit = automaton.audit(node, 0)[0]
        repaired = replay(signature, audit, 0, *([x[k] for x in kept] for k in (0, 1)))[1]
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, automaton.costs(node)[0], audit, sha)
    return out


@pytest.fixture(scope="module")
def talks():
    own = random.Random(9)
    says = ["Yes.", "no", " ", "", "why?\n", "Yes.", None, "\x85", "ok!\t", "é. x", "w" * 50_000 + "."]
    roles = ["user", "assistant", "system", "tool", None, "", "User", "user", "assistant"]
    rows = []
    for conv in [*range(30), None]:
        for turn in range(own.randrange(1, 9)):
            rows.append((conv, own.choice([turn, turn, turn * 3, None]), own.choice(roles), own.choice(says)))
    rows += [(77, t, own.choice(roles), f"{t % 400} {own.choice('.?x')}") for t in range(900)]
    rows += rows[5:9] + rows[5:7] + [(78, 4, "user", "same.")] * 40
    return rows


@pytest.mark.parametrize("most_rows", [7, 4096])
def test_repair_equals_plain_version(spark, talks, most_rows):
    table = spark.createDataFrame([(*r, "x", 1) for r in talks], "conv_id long, turn long, role string, text string, part string, n int").repartition(4)
    blocks = conversations.repaired_blocks(table, most_rows)
    got = {r.conv_id: tuple(r[1:]) for r in conversations.report(blocks).collect()}
    assert got == plain_repair(talks)
    rows = sorted((r.part, r.seq, r.place, r.role, r.text) for r in conversations.repaired_turns(blocks).filter("conv_id = 77").collect())
    assert hashlib.sha256("\n".join(f"{r}:{t}" for *_, r, t in rows).encode()).hexdigest() == got[77][-1]
    assert not got[77][6].replace("I", "").strip("KRD")


def test_repair_of_dropped_and_missing_conversations(spark):
    kinds = "conv_id long, turn long, role string, text string"
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = conversations.report(conversations.repaired_blocks(spark.createDataFrame([(gone, 0, "user", "hi.")], kinds))).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversations.report(conversations.repaired_blocks(spark.createDataFrame([], kinds))).collect() == []


# 13, frequent lines


def plain_lines(texts, ids, fewest=5):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))

    holders = defaultdict(set)
    for row, text in enumerate(texts):
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(row)
    out = []
    for i, text in zip(ids, texts, strict=True):
        kept = []
        for line in (text or "").split("\n"):
            rows = holders.get(key(line), ())
            named = [ids[r] for r in rows if ids[r] is not None]
            if len(rows) < fewest or not named or i == max(named):
                kept.append(line)
        lines = (text or "").count("\n") + 1
        out.append((i, lines, lines - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard", [2, 1 << 17])
def test_frequent_lines_equal_plain_version(spark, monkeypatch, shard):
    monkeypatch.setattr(frequent_lines, "SHARD_KEYS", shard)
    monkeypatch.setattr(frequent_lines, "SHARD_ASKED", shard)
    own = random.Random(4)
    stock = ["Line that stands in many documents, number %d" % k for k in range(9)] + ["所" * 40, "所" * 39, "É" * 40, "é" * 40, "short"]
    texts = [None, "", "\n\n"]
    for _ in range(80):
        lines = [own.choice(stock) for _ in range(own.randrange(6))] + [f"own line of this document alone {own.random()}"]
        own.shuffle(lines)
        texts.append("\n".join(own.choice([x, x.upper() if x.isascii() else x, f" \t{x}\r"]) for x in lines))
    texts += [texts[5]] * 6 + ["\n".join(stock * 3000)]
    ids = [None if k % 11 == 3 else k - 20 for k in range(len(texts))]
    ids[-2] = ids[-3]
    for docs in (documents(spark, texts, ids), clashing(spark, texts, ids)):
        got = sorted((tuple(r) for r in frequent_lines.without_frequent_lines(docs).collect()), key=repr)
        assert got == plain_lines(texts, ids)


def test_frequent_lines_of_few_rows(spark):
    line = "x" * 40
    assert frequent_lines.without_frequent_lines(documents(spark, [])).collect() == []
    nameless = documents(spark, [line] * 6, [None] * 6)
    assert {r.n_dropped for r in frequent_lines.without_frequent_lines(nameless).collect()} == {0}
    assert {r.n_dropped for r in frequent_lines.without_frequent_lines(documents(spark, [line] * 4)).collect()} == {0}


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_numbers_its_keys(n):
    own = np.random.default_rng(n)
    hi, lo = (own.integers(0, 2**63, n).astype(np.uint64) for _ in range(2))
    hi[: n // 2] = hi[:1] if n else 0  # half of the keys differ in one half only
    built = PerfectHash.build(hi, lo)
    assert sorted(built.numbers(hi, lo).tolist()) == list(range(n))
    again = PerfectHash(built.sizes, built.words)
    assert (again.numbers(hi, lo) == built.numbers(hi, lo)).all()
    assert built.words.nbytes * 8 <= 6 * n + 64 * 40
    strange = own.integers(0, 2**63, 100).astype(np.uint64)
    assert (built.numbers(strange, strange) < max(n, 1)).all()
