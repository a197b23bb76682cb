import hashlib
import random
from collections import defaultdict

from parkops.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, msg string, depth string"
BITS = ["</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "\\", "<", "[", "<\\/s>", "[\\\\INST]", "\n", "user", "é", "<<SYS>>", "<s>", "$1", " "]


def frame(spark, data):
    return spark.createDataFrame([(*r, "x", "x") for r in data], SCHEMA).repartition(3)


def test_conversations_read_back(spark):
    rng = random.Random(16)
    data = []
    for c in range(60):
        for t in range(rng.randrange(1, 9)):
            data.append((c, t, rng.choice(["user", "assistant", "system", "a\\n\nb<|im_end|>"]), "".join(rng.choices(BITS, k=rng.randrange(0, 12)))))
    data += [(100, 0, None, None), (101, 0, "assistant", ""), (102, None, "user", "first"), (102, 1, "assistant", "x" * 200_000), (103, 0, "user", "a"),
             (103, 0, "user", "a"), (None, 3, "assistant", "lost"), *[(104, t, "assistant", f"{t}<s>") for t in range(150)]]
    want = defaultdict(list)
    for c, t, role, text in sorted(data, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    out = chat.format_conversations(frame(spark, data)).collect()
    assert len(out) == len(want)
    for r in out:
        turns, learned = chat.read_back(r.formatted, r.loss_spans)
        assert turns == want[r.conv_id]
        assert learned == "".join(t for role, t in turns if role == "assistant")
        assert r.formatted.count(chat.OPEN) == r.formatted.count(chat.CLOSE) == len(turns)
        bare = r.formatted.replace(chat.OPEN, "").replace(chat.CLOSE, "")
        assert not any(c in bare for c in chat.CONTROL)


def test_digests_come_from_the_output(spark):
    df = chat.format_conversations(frame(spark, [(1, 0, "user", "q"), (1, 1, "assistant", "</s>a")]))
    row = df.select(chat.digests().alias("d")).select("d.*").first()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (row.n_turns, row.turns_sha256, row.loss_chars, row.loss_sha256) == (2, sha("user\nq\nassistant\n</s>a\n"), 5, sha("</s>a"))


def test_paths_of_trees_equal_brute_force(spark):
    rng = random.Random(17)
    nodes = {}
    for i in range(1, 300):
        nodes[i] = (rng.choice([None, *range(1, i)][-12:]) if i > 1 and rng.random() < .97 else None, round(rng.random(), 3))
    nodes[400] = (399, 0.5)                       # its parent is missing
    nodes[500], nodes[501] = (501, 1.0), (500, 1.0)   # a cycle
    children = defaultdict(list)
    for i, (p, _) in nodes.items():
        if p in nodes:
            children[p].append(i)
    want = {}
    best = defaultdict(list)
    for leaf in nodes:
        if not children[leaf] and leaf < 500:
            path, at = [], leaf
            while at in nodes:
                path.insert(0, at)
                at = nodes[at][0]
            best[path[0]].append((-sum(nodes[x][1] for x in path) / len(path), leaf, path))
    for tree, paths in best.items():
        for b, (_, _, path) in enumerate(sorted(paths, key=lambda x: (round(x[0], 9), x[1]))[:2], 1):
            want[tree, b] = path
    df = spark.createDataFrame([(i, p, s) for i, (p, s) in nodes.items()], "msg long, parent long, score double")
    got = defaultdict(list)
    for r in chat.chosen_paths(df, top=2).collect():
        got[r.tree, r.branch].append((r.depth, r.msg))
    assert {k: [m for _, m in sorted(v)] for k, v in got.items()} == want
    assert all([d for d, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())


def test_empty(spark):
    assert chat.format_conversations(frame(spark, [])).count() == 0
