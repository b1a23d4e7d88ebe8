"""Operators 11 to 13 on small fixtures: brute force and defined cases."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest

from presswatch.llm.licences import ANCHORS, BASE_PHRASES, MIN_COVERAGE, RESULT, TEMPLATES, licences
from presswatch.llm.repair import lightest_repair, repaired_conversations

# 13: conversation repair.

ROLES = ["system", "user", "assistant", "tool", " "]
TEXTS = ["Hi.", "Hi", "ok!", " ", "", "why?", "Hi."]


def brute_repair(roles, texts):
    """Every edit sequence with at most one insert before each row and at the end: the least (cost, audit)."""
    blank = [not re.search(r"[^\x20\x09-\x0D]", t) for t in texts]
    seen, fault = set(), []
    for r, t, b in zip(roles, texts, blank):
        last = re.findall(r"[^\x20\x09-\x0D]", t)
        fault.append("blank" if b else "dup" if (r, t) in seen else "cut" if last[-1] not in ".!?" else "")
        seen.add((r, t))
    best = None
    row_choices = [["D"] if f in ("blank", "dup") else ["D", "K", "Ru", "Ra"] for f in fault]
    for edits in itertools.product(*row_choices):
        for gaps in itertools.product(["", "Iu", "Ia"], repeat=len(roles) + 1):
            cost, audit, out = 0, "", []
            for i in range(len(roles) + 1):
                if gaps[i]:
                    cost, audit = cost + 5, audit + "I"
                    out.append(("user" if gaps[i] == "Iu" else "assistant", ""))
                if i == len(roles):
                    break
                e = edits[i]
                audit += e[0]
                if e == "D":
                    cost += 2
                    continue
                role = roles[i]
                if e != "K":
                    new = "user" if e == "Ru" else "assistant"
                    if new == role:
                        cost = None
                        break
                    role, cost = new, cost + 1
                cost += 5 if fault[i] == "cut" else 0
                out.append((role, texts[i]))
            if cost is None or not re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] for r, _ in out)):
                continue
            cand = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
            best = cand if best is None or cand < best else best
    return best


def test_repair_is_the_least_derivation():
    draw = random.Random(13)
    for _ in range(120):
        n = draw.randint(0, 4)
        roles = [draw.choice(ROLES) for _ in range(n)]
        texts = [draw.choice(TEXTS) for _ in range(n)]
        blank = [not re.search(r"[^\x20\x09-\x0D]", t) for t in texts]
        cut = [not b and re.findall(r"[^\x20\x09-\x0D]", t)[-1] not in ".!?" for t, b in zip(texts, blank)]
        if n == 0:
            continue
        _, _, _, cost, audit, text = lightest_repair(roles, texts, blank, cut)
        assert (cost, audit, text) == brute_repair(roles, texts), (roles, texts)


def test_repair_inserts_and_ties():
    # Two users in a row: deleting the second costs 2, an insert 5; a lone assistant is reroled.
    assert lightest_repair(["user", "user", "assistant"], ["a.", "b.", "c."], [False] * 3, [False] * 3)[3:5] == (2, "DKK")
    assert lightest_repair(["assistant"], ["a."], [False], [False])[3:5] == (2, "D")
    assert lightest_repair(["system", "assistant"], ["a.", "b."], [False] * 2, [False] * 2)[3:5] == (1, "RK")


def damage_of(conv_id, turn):
    key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
    return zlib.crc32(key.encode()) % 20


def python_repair(rows):
    """The whole query in plain Python: damage, order, faults, repair."""
    by_conv = {}
    for conv_id, turn, role, text in rows:
        by_conv.setdefault(conv_id, [])
        d = damage_of(conv_id, turn)
        if d == 0:
            continue
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if d == 1 else re.sub(r"[.!?]", "", text) if d == 2 else text
        role = "user" if d == 4 else role
        by_conv[conv_id] += [(turn, role, text)] * (2 if d == 3 else 1)
    out = {}
    for conv_id, live in by_conv.items():
        live.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {t for t, _, _ in live if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        blank = [not re.search(r"[^\x20\x09-\x0D]", t) for _, _, t in live]
        cut = [not b and re.findall(r"[^\x20\x09-\x0D]", t)[-1] not in ".!?" for (_, _, t), b in zip(live, blank)]
        if live:
            dup, n_cut, illegal, cost, audit, text = lightest_repair([r for _, r, _ in live], [t for _, _, t in live],
                                                                     blank, cut)
        else:
            dup = n_cut = illegal = cost = 0
            audit = text = ""
        out[conv_id] = (gaps, sum(blank), dup, n_cut, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def conversations(spark):
    draw = random.Random(7)
    rows = []
    for conv in range(40):
        for turn in range(draw.randint(1, 9)):
            rows.append((conv, turn if draw.random() > 0.05 else None, draw.choice(ROLES + [None, "user", "assistant"]),
                         draw.choice(TEXTS + [None, "a long one " * 300 + "end."])))
    rows += [(None, 1, "user", "x."), (None, None, None, None), (41, 3, "user", "same."), (41, 3, "user", "same."),
             (42, 0, "assistant", "Ünïcode ½ 🙂.")]
    rows += [(c, t, r, x) for c, t, r, x in rows[:10]]  # repeated rows
    schema = "conv_id long, turn long, role string, text string, audit string, cost int, gone int, copy string"
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], schema), rows


def test_repair_table_is_python(spark, conversations):
    table, rows = conversations
    got = {r.conv_id: tuple(r)[1:] for r in repaired_conversations(table).collect()}
    assert got == python_repair(rows)
    empty = spark.createDataFrame([], table.schema)
    assert repaired_conversations(empty).count() == 0


def test_repair_of_dropped_conversations(spark):
    # Find a (conv_id, turn) that the damage drops: its conversation stays with zeros and the empty hash.
    conv = next(c for c in range(1000) if damage_of(c, 0) == 0)
    table = spark.createDataFrame([(conv, 0, "user", "hello.")], "conv_id long, turn long, role string, text string")
    (row,) = repaired_conversations(table).collect()
    assert tuple(row) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# 11: licence scans.

def licence_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def python_licences(texts):
    """The method in plain Python over all texts: document frequencies, anchors, votes, keys, coverage."""
    all_words = [licence_words(t) for t in texts]
    vocab = {w for _, n, _ in TEMPLATES for w in n.split()} | {w for p, _ in BASE_PHRASES for w in p.split()}
    df = {w: sum(w in set(ws) for ws in all_words) for w in vocab}
    out = []
    for ws in all_words:
        base = [(i, label) for phrase, label in BASE_PHRASES for i in range(len(ws))
                if ws[i:i + len(phrase.split())] == phrase.split()]
        places = [i for i, _ in base]
        base_labels = sorted({label for _, label in base})
        named, best = set(), None
        for label, notice, keys in TEMPLATES:
            nw = notice.split()
            anchors = sorted({w for w in ws if w in nw}, key=lambda w: (df[w], w))[:ANCHORS]
            votes = sorted(i - s for i, w in enumerate(ws) if w in anchors for s, x in enumerate(nw) if x == w)
            cands = set(votes) if len(anchors) <= 1 else {v for v, n in collections.Counter(votes).items() if n >= 2}
            for o in cands:
                at = lambda k: ws[o + k] if 0 <= o + k < len(ws) else None
                starts = [next(i for i in range(len(nw)) if nw[i:i + len(k.split())] == k.split()) for k in keys]
                if not all(at(s + j) == x for s, k in zip(starts, keys) for j, x in enumerate(k.split())):
                    continue
                cover = sum(at(k) == x for k, x in enumerate(nw)) / len(nw)
                best = cover if best is None else max(best, cover)
                if cover >= MIN_COVERAGE:
                    named.add(label)
        out.append((len(ws), len(base), min(places, default=None), max(places, default=None), ",".join(base_labels),
                    ",".join(sorted(set(base_labels) | named)), best or 0.0))
    return out



def test_licences_are_python(spark):
    notices = [n for _, n, _ in TEMPLATES]
    texts = [None, "", "  \n", "All Rights Reserved. CC BY 4.0 and cc by-nc 4.0", "Licensed under the Apache License, "
             "Version 2.0.", "Released under the MIT License. " * 3, "licensed under the GNU general public license "
             "version 3; version 2", "x " * 20000 + "general public license", "mit license under released the",
             "Permission is hereby granted, free of charge, to any person obtaining", "apache license apache license",
             "Redistribution and use in source and binary forms are permitted.", "licensed under cc by sa", "é日本 ½"]
    texts += [" ".join(random.Random(i).sample(" ".join(notices).split(), 12)) for i in range(30)]
    texts += texts[3:6]
    rows = [(i, t, "x", 1.5, 7) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, labels string, Score double, words int")
    got = licences(table).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in RESULT) for r in got] == python_licences(texts)
    assert set(got[0].asDict()) == {"doc_id", "text", "words", *RESULT}
    assert licences(spark.createDataFrame([], table.schema)).count() == 0


# 12: periodic runs.


def brute_runs(w, min_length=12):
    """Every maximal stretch of each period q whose smallest period is q, by start, then period."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            smaller = any(all(w[x] == w[x + p] for x in range(i, i + length - p)) for p in range(1, q))
            if length >= max(min_length, 2 * q) and not smaller:
                out.append((i, length, q))
            i = j
    return sorted(out)


def python_runs_query(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    gone = {x for s, length, q in runs for x in range(s + q, s + length)}
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    digest = hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(runs), *(top or (None,) * 3), None if top is None else top[1] * 1000 // top[2], digest,
            hashlib.sha256(kept.encode()).hexdigest())


def test_runs_query_is_brute_force(spark, monkeypatch):
    from presswatch.llm import q12_runs

    draw = random.Random(12)
    texts = [None, "", " \t\n", "a " * 30, "a b " * 9 + "c", "x\ty\nx\ty\nx\ty\nx\ty\nx\ty\nx\ty\nx z", "é 日本 🙂 " * 8]
    texts += [" ".join(draw.choice("ab") for _ in range(draw.randint(10, 70))) for _ in range(25)]
    texts += [" ".join(draw.choice(["the", "cat", "sat", "on", "mat", "a"]) for _ in range(draw.randint(0, 120)))
              for _ in range(25)]
    texts += ["w " * 700 + "tail", texts[8]]
    ids = [None] + list(range(len(texts) - 2)) + [10, 10]
    rows = [(d, t, 1, "c") for d, t in zip(ids, texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string")
    monkeypatch.setattr(q12_runs, "read", lambda spark, sf_dir, name: table)
    got = sorted((tuple(r) for r in q12_runs.op12_periodic_runs(spark, "unused").collect()),
                 key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))
    want = sorted(((d, *python_runs_query(d, t)) for d, t in zip(ids, texts)),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))
    assert got == want
    assert sum(r[1] > 0 for r in got) > 10


def test_runs_table_keeps_columns(spark):
    from presswatch.llm.runs import periodic_runs

    table = spark.createDataFrame([(1, "a b a b a b a b a b a b a b", "x")], "id long, body string, RUNS string")
    (row,) = periodic_runs(table, text_col="body").collect()
    assert row.asDict() == {"id": 1, "body": "a b a b a b a b a b a b a b",
                            "runs": [(0, 14, 2)], "collapsed": "a b"}
    assert periodic_runs(spark.createDataFrame([], table.schema), text_col="body").count() == 0
