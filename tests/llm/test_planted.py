"""What the methods add on whole documents with planted cases: recall and false discoveries, as the README tells them."""

import random
import string

from loomline.llm import pii, secrets

SF = "/root/testdata/sf0.01"
ALPHABETS = {"base64": string.ascii_letters + string.digits + "+/", "base62": string.ascii_letters + string.digits, "base36": string.ascii_lowercase + string.digits, "HEX": "0123456789ABCDEF"}


def texts(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


def test_random_tokens(spark):
    rng, planted, docs = random.Random(11), {}, []
    for i, (d, t) in enumerate(texts(spark)):
        words = t.split(" ")
        if i % 2 == 0:
            token = "".join(rng.choices(ALPHABETS[rng.choice(list(ALPHABETS))], k=rng.choice([16, 20, 24, 32, 40, 64])))
            words.insert(rng.randrange(len(words) + 1), token)
            planted[d] = token
        docs.append((d, " ".join(words)))
    text, found, false = dict(docs), set(), 0
    for r in secrets.find_secrets(spark.createDataFrame(docs, "doc_id long, text string").repartition(8)).select("doc_id", "spans").collect():
        for s in r.spans:
            if s.kind == 3:
                hit = text[r.doc_id][s.start : s.end] == planted.get(r.doc_id)
                found |= {r.doc_id} if hit else set()
                false += not hit
    by = {n: [d in found for d, t in planted.items() if len(t) == n] for n in (16, 20, 24, 32, 40, 64)}
    recall = {n: sum(x) / len(x) for n, x in by.items()}
    print("random tokens", {n: f"{sum(x)}/{len(x)}" for n, x in by.items()}, "false", false)
    assert false <= 3 and recall[24] >= 0.3 and recall[32] >= 0.75 and recall[40] >= 0.9 and recall[64] >= 0.95


def test_identifiers_in_known_contexts(spark, monkeypatch):
    rng, truth, docs = random.Random(12), {}, []
    for i, (d, t) in enumerate(texts(spark)):
        words, own = t.split(" "), None
        number = rng.randrange(10**6, 10**7)
        if i % 10 == 0:
            own = f"please call our office at +4930{number} before noon"
        elif i % 10 == 1:
            truth[d] = f"030-{number}"
            own = f"please call our office at {truth[d]} before noon"
        elif i % 10 == 2:
            own = f"send the file to user{i}@mail.example.org by friday"
        elif i % 10 == 3:
            truth[d] = f"user{i}(at)mail-example"
            own = f"send the file to {truth[d]} by friday"
        if own:
            at = rng.randrange(len(words) + 1)
            words[at:at] = own.split(" ")
        docs.append((d, " ".join(words)))
    text, found, false = dict(docs), set(), 0
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    rows = pii.find_personal_data(df).collect()
    for r in rows:
        base = {(s.start, s.end) for s in r.base}
        for s in r.spans:
            if (s.start, s.end) not in base:
                hit = text[r.doc_id][s.start : s.end] == truth.get(r.doc_id)
                found |= {r.doc_id} if hit else set()
                false += not hit
    print("identifiers", len(found), "of", len(truth), "false", false)
    assert len(found) >= 0.9 * len(truth) and false <= 0.05 * len(truth)
    monkeypatch.setattr(pii, "EXACT", 0)  # by bitmaps: the same
    assert sorted((r.doc_id, r.spans) for r in pii.find_personal_data(df).collect()) == sorted((r.doc_id, r.spans) for r in rows)
