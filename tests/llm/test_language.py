import random
from collections import Counter, defaultdict

from helpers import CLASHING, frame
from parkops.llm import language

STEMS = {"aa": ["kor", "tal", "min", "ros"], "bb": ["ßel", "öng", "üch", "kor"], "cc": ["ção", "nho", "lha", "tal"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randrange(1, 4))).capitalize() + rng.choice(["", ".", ",", " 42"])
                    for _ in range(n))


def rows():
    rng = random.Random(7)
    out = [(i, text(rng, lang, rng.randrange(3, 60)), lang, "s") for i, lang in enumerate(rng.choices(["aa", "bb", "cc"], [8, 1, 1], k=300))]
    return out + [(300, None, "aa", None), (301, "", "bb", None), (302, "12 34 !!", "cc", None), (303, text(rng, "bb", 9), None, None),
                  (304, "kor" * 50_000, "aa", None), (305, "漢字仮名交じり文", None, None),
                  (306, "² ½ 42", "aa", None), (307, "Ⅷ ① ⑫", None, None), (308, "kor² x½tal Ⅷmin①ros", None, None), (1, out[1][1], out[1][2], None)]


def grams(t, top):
    c = Counter()
    word = ""
    for ch in (t or "").lower() + " ":
        if ch.isalpha():
            word += ch
        elif word:
            p = f" {word} "
            c.update(p[i:i + n] for n in (1, 2, 3, 4) for i in range(len(p) - n + 1) if p[i:i + n] != " ")
            word = ""
    return [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:top]], c


def test_equals_brute_force_and_held_out_accuracy(spark):
    data = rows()
    df = frame(spark, data, CLASHING)
    got = language.identify(df, df.where("doc_id % 4 != 2")).collect()
    counts = defaultdict(Counter)
    for i, t, lang, _ in data:
        if i % 4 != 2 and lang:
            counts[lang] += grams(t, 400)[1]
    profile = {lang: {g: r for r, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:400])} for lang, c in counts.items()}
    want = {}
    for i, t, *_ in data:
        own = grams(t, 400)[0]
        apart = {lang: sum(abs(p[g] - r) if g in p else 400 for r, g in enumerate(own)) for lang, p in profile.items()}
        lang = min(sorted(apart), key=apart.get)
        want[i] = (lang, 1 - apart[lang] / (400 * len(own))) if own else ("und", 0.0)
    assert len(got) == len(data)
    for r in got:
        assert r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-9 and 0 <= r.score <= 1
    held = [r for r in got if r.doc_id % 4 == 2 and r.lang and r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {300, 301, 302, 306, 307}


def test_nothing_learned_and_empty(spark):
    df = frame(spark, [(1, "kor tal", None, None)])
    assert [(r.lang_pred, r.score) for r in language.identify(df, df).collect()] == [("und", 0.0)]
    none = frame(spark, [])
    assert language.identify(none, df).count() == 0
