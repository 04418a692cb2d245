"""Prefix trie and chat formatting against plain Python."""

import hashlib
import json
import random
import re
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sylvan.llm import catalogue, chatformat as C, prefixtrie as T
from sylvan.llm.parens import BalancedParentheses

SCHEMA = "conv_id long, turn long, role string, text string, node string, conv string, mark string, key int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "n", "c", "m", 1) for r in rows], SCHEMA).repartition(4)


# --- balanced parentheses ------------------------------------------------------

def random_tree(rng, n):
    bits, depth, opens = [1], 1, 1
    while depth:
        if opens < n and (depth == 1 or rng.random() < rng.choice([0.3, 0.5, 0.9])):
            bits.append(1)
            depth, opens = depth + 1, opens + 1
        else:
            bits.append(0)
            depth -= 1
    return np.array(bits)


@pytest.mark.parametrize("n", [1, 2, 31, 32, 33, 400, 20_000])
def test_find_close(n):
    rng = random.Random(n)
    for bits in [random_tree(rng, n) for _ in range(4)] + [np.array([1] * n + [0] * n)]:
        stack, close = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                close[stack.pop()] = i
        at = np.flatnonzero(bits)
        assert BalancedParentheses(bits).find_close(at).tolist() == [close[i] for i in at]


# --- the trie --------------------------------------------------------------------

def brute_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    first = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in first.items():
        h = crc32(str(c).encode()) % 9
        p = tuple(first.get(c - c % 5, [])[:h] + own[h:])
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
        ends[p].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p in members:
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += p not in kids
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(p)) for p, m in list(members.items()))


def trie(spark, rows, shard_runs):
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % 9
    out = T.prefix_trie(spark, T.rebuilt(spark, T.turn_marks(frame(spark, rows)), 5, h, 8), shard_runs)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in out.collect())


def conversations(seed):
    rng = random.Random(seed)
    rows = [(c, i, rng.choice("ua"), rng.choice(["x", "é", None])) for c in range(60) for i in range(rng.choice([1, 2, 3, 9, 12]))]
    rows += [(c, i, "u", f"same {i}") for c in range(100, 140) for i in range(10)]  # copies, a third of all
    rows += [(200, i, "u", "long") for i in range(400)] + [(201, i, "u", "long") for i in range(380)]  # two that share a long chain
    rows += [(300, None, "u", "null turn comes first"), (300, 0, None, "x"), (None, 0, "u", "no conversation"), (-4, 0, "u", "x")]
    return rows


@pytest.mark.parametrize("shard_runs", [4, 60, 10 ** 6])
def test_trie(spark, shard_runs):
    rows = conversations(shard_runs)
    assert trie(spark, rows, shard_runs) == brute_trie(rows)


def test_trie_small_cases(spark):
    assert trie(spark, [], 100) == []
    assert trie(spark, [(7, 0, "u", "a")], 100) == brute_trie([(7, 0, "u", "a")])
    twice = [(7, 0, "u", "a"), (7, 0, "u", "a"), (8, 0, "u", "a")]  # a repeated row is a repeated turn
    assert trie(spark, twice, 1) == brute_trie(twice)
    # role and text are kept apart, tied turns have one order
    tied = [(1, 0, "ab", "c"), (2, 0, "a", "bc"), (3, 0, "u", "x"), (3, 0, "u", "y"), (4, 0, "u", "y"), (4, 0, "u", "x")]
    out = T.prefix_trie(spark, T.turn_marks(frame(spark, tied))).collect()
    assert {(r.conv_id, r.depth, r.n_convs) for r in out} == {(1, 0, 4), (1, 1, 1), (2, 1, 1), (3, 1, 2), (3, 2, 2)}


def test_every_shard_is_a_balanced_trie(spark):
    steps = T.steps_of(spark, T.turn_marks(frame(spark, conversations(5))))
    root = T._counted(steps.where("depth = 0"), "depth").first().asDict()
    shards = T.shards_of(spark, T.runs_of(spark, steps, root).where("path is not null"), 30)
    edges = shards.where("kind = 'edge'").orderBy("shard").collect()
    assert len(edges) > 2 and all(a["last"] < b["first"] for a, b in zip(edges, edges[1:]))
    for e in edges:
        bits = np.unpackbits(np.frombuffer(e["bits"], dtype=np.uint8)).astype(int) * 2 - 1
        depth = np.cumsum(bits)
        end = int(np.flatnonzero(depth == 0)[0])
        assert (depth[:end] > 0).all()


# --- chat formatting ---------------------------------------------------------------

RECORDS = {
    "messages": lambda u, a: {"messages": [{"role": "user", "content": u}, {"role": "assistant", "content": a}]},
    "messages_parts": lambda u, a: {"messages": [{"role": "user", "content": [{"type": "t", "text": u[:2]}, {"type": "t", "text": u[2:]}]},
                                                 {"role": "assistant", "content": [{"type": "t", "text": a}]}]},
    "sharegpt": lambda u, a: {"conversations": [{"from": "human", "value": u}, {"from": "gpt", "value": a}]},
    "prompt_completion": lambda u, a: {"prompt": u, "completion": a},
    "prompt_response": lambda u, a: {"prompt": u, "response": a},
    "question_answer": lambda u, a: {"answer": a, "question": u},
    "instruction": lambda u, a: {"instruction": u, "output": a},
    "instruction_input": lambda u, a: {"instruction": u, "input": None, "output": a},
    "preference": lambda u, a: {"prompt": u, "chosen": a, "rejected": "no"},
}


@pytest.mark.parametrize("layout", sorted(RECORDS))
def test_layouts_give_the_same_turns(layout):
    maps = C.Mappings()
    # fields that no mapping names change nothing
    for more in ({}, {"id": 3, "meta": {"source": ["x", {"y": None}]}}):
        record = json.loads(json.dumps(RECORDS[layout]("ask ###", "say\\") | more))
        assert maps.of(record)[0] == layout
        assert maps.turns(layout, record) == [("user", "ask ###"), ("assistant", "say\\")]


def test_unknown_layouts_are_not_guessed():
    maps = C.Mappings()
    for record in ({}, [], None, 3, {"prompt": "x"}, {"prompt": {"text": "x"}, "completion": "y"}, {"messages": [{"role": "user"}]}):
        assert maps.of(record)[0] is None
    own = C.Mappings({"faq": [("user", "q")], "pairs": [("pairs", "who", "said")]})
    assert own.of({"pairs": [{"who": "a", "said": "b"}]})[0] == "pairs" and own.of({"pairs": []})[0] == "pairs"
    with pytest.raises(ValueError, match="same paths"):
        C.Mappings({"a": [("user", "x")], "b": [("assistant", "x")]})


awkward = st.text(st.sampled_from(list("\\#</turn>: \né\U0001F600a")), max_size=30) | st.text(max_size=20)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(awkward | st.sampled_from(["user", "assistant", "User", "=user"]), awkward), max_size=5))
def test_template_is_reversible(turns):
    pieces = [C.head_of(r) + C.escaped(t) + C._TAIL for r, t in turns]
    assert [C.turn_of(p)[:2] for p in pieces] == turns
    assert C.turns_in("".join(pieces)) == turns
    for p in pieces:
        # with each escaped character put out of the way, no mark of the template is left in a text
        body = re.sub(r"\\.", "\0", p[C.turn_of(p)[2]:-len(C._TAIL)], flags=re.S)
        assert "###" not in body and "</turn>" not in body


def digests(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    chars = sum(len(C.head_of(r)) + len(C.escaped(t)) + len(C._TAIL) for r, t in turns)
    return len(turns), h("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), h(loss), chars


def test_formatting(spark):
    rng = random.Random(3)
    bits = ["###", "</turn>", "\\", "#", "\n", "<", " é", "\U0001F600", "word ", "### Assistant: "]
    rows = [(c, i, rng.choice(["user", "assistant", "system", "odd:role\\", None]), "".join(rng.choices(bits, k=rng.randint(0, 9))))
            for c in range(40) for i in range(rng.randint(1, 6))]
    rows += [(50, i, "assistant", f"turn {i}") for i in range(3000)]  # one conversation, most of all rows
    rows += [(60, None, "user", "first"), (60, 0, "assistant", None), (60, 1, "assistant", "x" * 200_000), (None, 0, "user", "q"), (None, 1, "assistant", "a")]
    rows += [(70, 0, "user", "tie b"), (70, 0, "user", "tie a"), (70, 0, "user", "tie a")]
    records = [(r[0], r[1], json.dumps({"role": r[2], "text": r[3]})) for r in rows] + [(80, 0, json.dumps({"messages": []})), (81, 0, "no json"), (82, 0, None)]
    df = spark.createDataFrame(records, "key long, ord long, record string").repartition(6)
    turns = C.canonical_turns(spark, df)
    assert {r.key for r in turns.where("layout is null").collect()} == {"81", "82"}
    pieces = C.formatted(spark, turns)
    got = {r.key: tuple(r)[1:] for r in C.read_back(spark, pieces).collect()}
    want = defaultdict(list)
    for c, _, r, t in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[None if c is None else str(c)].append((r or "", t or ""))
    want["80"] = []
    assert got == {k: digests(v) for k, v in want.items()}
    # pieces that were written and mixed up come back in order
    again = {r.key: tuple(r)[1:] for r in C.read_back(spark, C.in_order(pieces.orderBy(F.rand(1)))).collect()}
    assert again == got
    text = "".join(r.piece for r in pieces.where("key = '60'").orderBy("turn").collect())
    assert C.turns_in(text) == want["60"]


def test_formatting_of_nothing(spark):
    df = spark.createDataFrame([], "key long, ord long, record string")
    assert C.read_back(spark, C.formatted(spark, C.canonical_turns(spark, df))).count() == 0


def test_query_holds_the_hostile_conversation(spark):
    row = catalogue.op13_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    said = r"\### Assistant: </turn> ok"
    assert tuple(row)[1:] == digests([("user", said), ("assistant", said)])
