"""Template decontamination against a plain implementation of its definition, and rows that need care."""

import random
import re

from lodestar.llm import decontam as D


def plain_words(text):
    """(kind, lower-case word, whether a sentence begins) of ASCII text."""
    out, last = [], 0
    for m in re.finditer(r"[A-Za-z0-9](?:[A-Za-z0-9]|(?<=\d)[.,](?=\d))*", text):
        fresh = not out or any(c not in " \t,-'&/" for c in text[last : m.start()])
        last, w = m.end(), m.group()
        after = bool(out) and out[-1][0] == "number"
        if w[0].isdigit():
            kind = "number"
        elif w[0].isupper() and not fresh and re.search("[a-z]", w):
            kind = "name"
        elif after and w.lower() in D.UNITS:
            kind = "unit"
        else:
            kind = "literal"
        out.append((kind, w.lower(), fresh))
    return out


def plain_forms(text):
    """{form: [(what the window shows, slot value or None, literal?)]} of a text."""
    words = plain_words(text)
    joined = []
    for kind, w, fresh in words:
        if kind == "name" and joined and joined[-1][0] == "name" and not fresh:
            joined[-1][1].append(w)
        else:
            joined.append([kind, [w]])
    template = [(k if k != "literal" else w[0], tuple(w) if k != "literal" else None, k == "literal") for k, w in joined]
    case, before = [], None
    for kind, w, _ in words:
        k = ("unit" if before == "number" and w in D.UNITS else "literal") if kind == "name" else kind
        case.append((k, w))
        before = kind
    folded = [(f"<{k}>" if k != "literal" else w, w if k != "literal" else None, k == "literal") for k, w in case]
    verbatim = [(w, w if k == "number" else None, True) for k, w in case]
    return {"template": [(s if lit else f"<{s}>", v, lit) for s, v, lit in template], "folded": folded, "verbatim": verbatim}


def plain_windows(tokens, width, least):
    for p in range(len(tokens) - width + 1):
        part = tokens[p : p + width]
        if sum(lit for *_, lit in part) >= least:
            yield p, tuple(s for s, *_ in part), [v for _, v, _ in part]


def plain_matches(doc, item):
    d, i, best = plain_forms(doc), plain_forms(item), None
    n, least = len(i["template"]), min(D.LITERALS, D.WIDTH - 1)
    full = len(list(plain_windows(i["template"], D.WIDTH, least)))
    sparse = len(i["verbatim"]) <= D.WIDTH or n < D.WIDTH or full < n - D.WIDTH + 1
    aligned = {}
    for form in ("template", "folded", "verbatim"):
        size = len(i[form])
        width = min(D.WIDTH, size)
        if not size or (form != "verbatim" and width < D.SHORTEST) or (form == "verbatim" and not sparse):
            continue
        guard = 0 if form == "verbatim" else min(D.LITERALS, width - 1)
        seen = set()
        for q, shown, values in plain_windows(d[form], width, guard):
            if form == "verbatim" and width < D.WIDTH and shown in seen:
                continue
            seen.add(shown)
            for p, wanted, own in plain_windows(i[form], width, guard):
                if shown == wanted:
                    aligned.setdefault((q - p, form != "template"), []).append((p, width, size, own, values))
    for (_, by_word), hits in aligned.items():
        covered = {x for p, w, *_ in hits for x in range(p, p + w)}
        pairs = {(a, b) for *_, own, values in hits for a, b in zip(own, values, strict=True) if a is not None}
        share = len(covered) / hits[0][2]
        if share >= D.COVERAGE and len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
            row = (share, not by_word, len({p for p, *_ in hits}), any(a != b for a, b in pairs))
            best = row if best is None or row[:3] > best[:3] else best
    return best


def test_results_equal_a_plain_implementation(spark):
    rng = random.Random(12)
    vocabulary = "how many apples does keep at home if buys and sells the river bank old near then what is total of".split()
    names, units = ["Alice", "Bob Stone", "Carol", "Dave"], ["kg", "miles", "euros"]

    def text(n, dense):
        out = []
        for _ in range(n):
            x = rng.random()
            out.append(str(rng.randint(1, 9)) + (" " + rng.choice(units) if rng.random() < 0.4 else "") if x < dense else rng.choice(names) if x < dense + 0.15 else rng.choice(vocabulary))
            if rng.random() < 0.07:
                out[-1] += rng.choice([".", ",", ";"])
        return " ".join(out)

    items = [text(rng.choice([1, 3, 5, 6, 7, 9, 14, 25]), rng.choice([0.05, 0.2, 0.6])) for _ in range(40)]
    docs = []
    for k in range(160):
        t = rng.choice(items)
        if k % 4 == 1:
            t = re.sub(r"\d", lambda m: str(9 - int(m[0])), t)
        elif k % 4 == 2:
            t = t.replace("Alice", "Bob Stone") if k % 8 == 2 else t.upper()
        elif k % 4 == 3:
            words = t.split()
            cut = rng.randint(0, len(words) // 2)
            t = " ".join(words[cut : cut + max(1, len(words) // 2 + 2)])
        docs.append(" ".join([text(rng.randint(0, 20), 0.1), t, text(rng.randint(0, 20), 0.1), t if k % 5 == 0 else ""]))
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.coverage, r.n_windows, r.reparameterised) for r in D.contaminated(d, b).collect()}
    want = {(x, y): m for x, t in enumerate(docs) for y, i in enumerate(items) if (m := plain_matches(t, i))}
    assert set(got) == set(want) and len(got) > 100
    assert all(abs(got[k][0] - want[k][0]) < 1e-12 and got[k][1] == want[k][2] for k in want)


def test_scripts_without_spaces(spark):
    items = ["小明有12个苹果，他给了小红5个，还剩几个苹果？", "รถไฟวิ่งด้วยความเร็วเท่าไร", "太郎は３つのりんごを買いました。"]
    texts = ["题目如下。" + items[0] + "请回答下面的问题", items[0].replace("12", "30").replace("5", "7"), "ก่อนหน้านี้" + items[1] + "และต่อไป", "昨日" + items[2], "我们今天去公园散步然后回家吃晚饭", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = {(r.doc_id, r.item_id): r for r in D.contaminated(d, b).collect()}
    assert set(rows) == {(0, 0), (1, 0), (2, 1), (3, 2)}
    assert rows[1, 0].reparameterised and not rows[0, 0].reparameterised and rows[0, 0].coverage == 1.0


def test_repeated_and_missing_ids_and_long_matching_texts(spark):
    item = "the quick brown fox jumps over the lazy dog near the old river bank today"
    rows = [("a", "clean words only"), ("a", item), ("a", item), ("b", (item + " and ") * 2000), (None, "x " + item), (None, "clean"), ("c", " ".join(item.split()[:8])), ("c", " ".join(item.split()[8:]))]
    d = spark.createDataFrame(rows, "doc_id string, text string")
    b = spark.createDataFrame([(1, item), (1, "an other item of the same id with words enough to count")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.coverage, r.n_windows, r.at_token) for r in D.contaminated(d, b).collect()}
    assert got == {("a", 1): (1.0, 8, 0), ("b", 1): (1.0, 8, 0), (None, 1): (1.0, 8, 1), ("c", 1): (8 / 15, 1, 0)}
