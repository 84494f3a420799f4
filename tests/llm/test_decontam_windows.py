import random
import re

from loomline.llm import decontam
from test_text_operators import jaccard


def test_inserted_and_deleted_words_by_force(spark, make):
    rng = random.Random(17)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(n))) for i, n in enumerate((45, 59, 59, 80))]
    rows = []
    for k in range(80):
        words = rng.choice(items)[1].split()
        words[0] = words[-1] = "edited"
        at = rng.randrange(8, len(words) - 8)
        if k % 2:
            words[at:at] = ["put", "in"][: rng.randint(1, 2)]
        else:
            del words[at : at + rng.randint(1, 2)]
        rows.append((k, " ".join(f"x{rng.randrange(999)}" for _ in range(20)) + " " + " ".join(words) + " " + " ".join(f"y{rng.randrange(999)}" for _ in range(20))))
    rows.append((900, " ".join(items[1][1].split()[:55])))  # shorter than the item
    got = {(r.doc_id, r.item_id): (r.start_word, round(r.similarity, 9)) for r in decontam.contaminated(make(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want, narrow = {}, 0
    for i, t in rows:
        w = re.findall(r"[^\W_]+", t.lower())
        for j, it in items:
            item = it.split()
            scores = [jaccard(w[s : s + len(item)], item) for s in range(max(1, len(w) - len(item) + 1))]
            if (best := max(scores)) >= 0.8:
                want[i, j] = (scores.index(best), round(best, 9))
                # The starts at which a common shingle lies as in the item.
                at = {tuple(item[p : p + 5]): p for p in range(len(item) - 4)}
                old = {max(0, min(p - at[g], len(w) - len(item))) for p in range(len(w) - 4) if (g := tuple(w[p : p + 5])) in at}
                narrow += max(scores[s] for s in old) < 0.8
    found = {k for k in want if k in got}
    assert got.keys() <= want.keys() and len(found) >= 0.95 * len(want) > 20 and narrow > 0
    assert sum(got[k] == want[k] for k in found) >= 0.95 * len(found)


def test_recall_over_all_windows_with_swaps_insertions_and_deletions(spark, make):
    rng = random.Random(23)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(n))) for i, n in enumerate((30, 60, 100, 150))]
    rows = []
    for k in range(160):
        words = rng.choice(items)[1].split()
        for _ in range(rng.randint(1, 2)):
            at, other = (rng.randrange(len(words)) for _ in range(2))
            kind = rng.randrange(4)
            if kind == 0:
                words[at], words[other] = words[other], words[at]
            elif kind == 1:
                words[at:at] = ["put"]
            elif kind == 2:
                del words[at]
            else:  # the halves change places
                words = words[len(words) // 2 :] + words[: len(words) // 2]
        rows.append((k, " ".join([f"x{rng.randrange(999)}" for _ in range(rng.randint(0, 60))] + words + [f"y{rng.randrange(999)}" for _ in range(rng.randint(0, 60))])))
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(make(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for i, t in rows:
        w = t.split()
        for j, it in items:
            n = len(it.split())
            if max(jaccard(w[s : s + n], it.split()) for s in range(max(1, len(w) - n + 1))) >= 0.8:
                want.add((i, j))
    assert got <= want and len(got) >= 0.95 * len(want) > 50
