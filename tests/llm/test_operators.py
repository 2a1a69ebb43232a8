"""Each operator against brute force, SQL, another library or held-out rows, and on odd tables."""

import collections
import hashlib
import itertools
import re

import numpy as np
import pytest
from compare import compare
from pyspark.sql import functions as F

from chunkline.llm import bpe, chat, common, decontaminate, html_text, langid, line_dedup, minhash, queries, spotsigs, suffix_dedup, toxicity
from llm_edge import COPY, SF, docs, no_docs, table


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_duckdb(spark, name):
    compare(spark, SF, queries.queries()[name], queries.oracle_sql()[name])


# 1


def classes_by_force(texts, similarity=0.8):
    """Union of all pairs of multisets of shingles with the similarity."""
    bags = []
    for t in texts:
        h, _ = minhash.shingles([t])
        bags.append(collections.Counter(h.tolist()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            if a and b:
                both = sum((a & b).values())
                if both >= similarity * (sum(a.values()) + sum(b.values()) - both):
                    lo, hi = sorted((find(i), find(j)))
                    root[hi] = lo
    return [find(i) for i in range(len(texts))]


def test_near_duplicates(spark):
    d = table(spark, "documents").select("doc_id", "text").orderBy("doc_id").toPandas()
    want = {int(d.doc_id[i]): int(d.doc_id[r]) for i, r in enumerate(classes_by_force(list(d.text)))}
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(table(spark, "documents")).collect()}
    assert got == want


def test_near_duplicates_odd(spark):
    got = sorted(((r["doc_id"] or -1), r["class_id"]) for r in minhash.near_duplicates(docs(spark)).collect())
    of = dict(got)
    assert len(got) == docs(spark).count()
    assert of[1] == 1 and of[2] == 2 and of[3] == 3 and of[9] == 9 and of[4] == of[5] == 4
    assert of[-1] is None and of[6] is None and of[7] is None and of[10] == 10
    assert minhash.near_duplicates(no_docs(spark)).count() == 0


def test_hubs_and_chains_are_one_class(spark):
    """A large group of near copies, and a chain in which only neighbours are alike."""
    words = [f"w{i}" for i in range(200)]
    hub = [(i, " ".join(words[:i] + [f"x{i}"] + words[i + 1 :])) for i in range(120)]
    chain = [(1000 + i, " ".join(f"c{j}" for j in range(i * 8, i * 8 + 200))) for i in range(15)]
    d = spark.createDataFrame(hub + chain, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(d).collect()}
    assert {got[i] for i, _ in hub} == {0} and {got[i] for i, _ in chain} == {1000}


def test_links_in_crowded_buckets(spark):
    """Texts that share most bands but are not alike, and pairs among them that are, mostly in those buckets alone."""
    stem = [f"s{i}" for i in range(240)]
    texts = [" ".join(stem + [f"t{i}x{j}" for j in range(40)]) for i in range(300)]
    texts += [" ".join(stem + [f"t{i}x{j}" if j < 12 else f"u{i}x{j}" for j in range(40)]) for i in range(25)]
    want = dict(enumerate(classes_by_force(texts)))
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(set(want.values())) == 300 and got == want


def families(n_families, members, words=200):
    """Families of texts with a likeness of about 0.7 within, and in each two texts with one of about 0.9."""
    rng = np.random.default_rng(11)
    texts, planted = [], []
    for f in range(n_families):
        stem = [f"f{f}w{i}" for i in range(words)]
        for m in range(members):
            own = list(stem)
            own[-34:] = [f"f{f}m{m}x{i}" for i in range(34)]
            texts.append(own)
        a, b = rng.choice(members, 2, replace=False) + f * members
        texts[b] = texts[a][:-8] + [f"late{f}x{i}" for i in range(8)]
        planted.append((int(a), int(b)))
    return [" ".join(t) for t in texts], planted


def test_no_link_is_lost_in_families_that_are_not_alike(spark):
    texts, planted = families(16, 120)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[a] == got[b] for a, b in planted) and len(set(got.values())) == len(texts) - len(planted)


def test_copies_of_an_original_that_are_not_alike(spark):
    """Each copy has a likeness of 0.83 to the original and of about 0.7 to the other copies."""
    rng = np.random.default_rng(2)
    stem = [f"o{i}" for i in range(300)]
    texts = [" ".join(stem)]
    for c in range(400):
        own = list(stem)
        for k in rng.choice(58, 5, replace=False):
            own[k * 5 + 4] = f"c{c}k{k}"
        texts.append(" ".join(own))
    got = {r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0}


def test_near_duplicates_repeated_ids(spark):
    other = " ".join(f"z{i}" for i in range(30))
    d = spark.createDataFrame([(1, COPY), (1, COPY), (2, other), (2, COPY), (3, other), (4, COPY)], "doc_id long, text string")
    got = minhash.near_duplicates(d).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 1, 2, 2, 3, 4] and {r["class_id"] for r in got if r["doc_id"] in (1, 4)} == {1}
    assert len({r["class_id"] for r in got if r["doc_id"] == 2}) == 1


def test_parity_never_parts_alike_texts():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcd"), rng.integers(1, 900))) for _ in range(60)]
    bag = minhash.counted(*minhash.shingles(texts))
    bits, els = minhash.parity(*bag, len(texts)), [collections.Counter() for _ in texts]
    for d, h, c in zip(*bag, strict=True):
        els[d][int(h)] += int(c)
    for i, a in enumerate(els):
        for j, b in enumerate(els[:i]):
            assert sum(int(x).bit_count() for x in (bits[i] ^ bits[j]).view(np.uint64)) <= sum(((a - b) + (b - a)).values())


def test_bag_minhash_is_unbiased():
    a, b = ["x"] * 50 + ["y"] * 30 + ["q"] * 3, ["x"] * 20 + ["y"] * 60 + ["k"]
    h = np.concatenate([minhash.words_hashed(w)[0] for w in (a, b)])
    d = np.repeat([0, 1], [len(a), len(b)])
    s = minhash.bag_minhash(*minhash.counted(h, d), 2, 16384)
    assert (s[0] == s[1]).mean() == pytest.approx(50 / 114, abs=0.02)


# 2


def removed_by_force(rows, n=50):
    first, out = {}, []
    for i, b in rows:
        for p in range(len(b) - n + 1):
            first[b[p : p + n]] = min(i, first.get(b[p : p + n], i))
    for i, b in rows:
        gone = np.zeros(len(b) + n, bool)
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < i:
                gone[p : p + n] = True
        gone = gone[: len(b)]
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(spark):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in table(spark, "documents").select("doc_id", "text").collect()]
    rows += [(5000 + i, b"abc" * 40 + bytes([97 + i]) * 70 + rows[i][1][:i * 13]) for i in range(12)]
    d = spark.createDataFrame([(i, b.decode("utf-8", "ignore")) for i, b in rows], "doc_id long, text string")
    rows = [(i, b.decode("utf-8", "ignore").encode()) for i, b in rows]
    got = [tuple(r) for r in suffix_dedup.dedup_strings(d, digests=True).collect()]
    assert sorted(got) == sorted(removed_by_force(rows))


def test_suffix_dedup_odd(spark):
    rows = [(-(2**63) if r["doc_id"] is None else r["doc_id"], (r["text"] or "").encode()) for r in docs(spark).select("doc_id", "text").collect()]
    got = [(-(2**63) if r["doc_id"] is None else r["doc_id"], *r[1:4], hashlib.sha256(r["kept"]).hexdigest()) for r in suffix_dedup.dedup_strings(docs(spark)).collect()]
    assert sorted(got) == sorted(removed_by_force(rows))
    of = {r[0]: r for r in got}
    assert of[-(2**63)][2] == 0 and of[6][2] == len(COPY) == of[6][1] and of[5][2] == of[5][1] > 100_000
    assert suffix_dedup.dedup_strings(no_docs(spark)).count() == 0


def test_suffix_dedup_rows_of_one_id(spark):
    """Each row of an id loses its own repeats only."""
    a, b = COPY, "".join(chr(97 + i * i % 23) for i in range(111))
    rows = [(1, a), (2, a), (2, b), (2, b), (3, b[20:90] + a[:60]), (3, a[40:])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in suffix_dedup.dedup_strings(d, digests=True).collect()]
    assert sorted(got) == sorted(removed_by_force([(i, t.encode()) for i, t in rows]))
    assert [r[2] for r in got if r[0] == 2 and r[1] == 111] == [0, 0]


# 3


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "be <turn:user> & nice"), (1, 1, "user", None), (1, 2, "assistant", "</turn>\n<again:user>\n"), (1, 3, None, "x" * 9000), (1, 4, "assistant", "&lt;&amp;lt; ok"), (2, None, "a>b\nc", ""), (None, 0, "assistant", "z"), (1, 5, "user", "u"), (1, 6, "assistant", "v")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("q")).withColumn("ord", F.lit(1))
    w = chat.format_windows(d, budget=60, history=20)
    read = chat.read_windows(w).orderBy("conv_id", "window").collect()
    back = collections.defaultdict(list)
    loss = collections.defaultdict(str)
    for r in read:
        back[r["conv_id"]] += [(t["role"], t["text"]) for t in r["turns"] if not t["again"]]
        loss[r["conv_id"]] += r["loss_text"]
    assert back[1] == [(r[2] or "", r[3] or "") for r in rows if r[0] == 1] and back[2] == [("a>b\nc", "")] and back[None] == [("assistant", "z")]
    assert loss[1] == "".join(r[3] or "" for r in rows if r[0] == 1 and r[2] == "assistant")
    later = [r for r in read if r["conv_id"] == 1][1:]
    assert later and all(r["turns"][0]["again"] and r["turns"][0]["role"] == "system" for r in later)
    assert chat.format_windows(d.limit(0)).count() == 0


@pytest.mark.parametrize(("budget", "history"), [(512, 128), (60, 20), (120, 0), (30, 29)])
def test_chat_windows_keep_the_budget(spark, budget, history):
    """All windows of the table and of turns of 39: over the budget only where one own turn, with the system turn, is."""
    rows = [(-1, i, "user" if i % 2 else "assistant", "x" * 140) for i in range(9)] + [(-2, 0, "system", "s" * 160)] + [(-2, i, "user", "y" * (i * 7 % 90)) for i in range(1, 200)]
    d = table(spark, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    windows = chat.format_windows(d, budget=budget, history=history)
    size = lambda t: 4 + -(-len(t["text"]) // 4)
    seen = collections.Counter()
    for r in chat.read_windows(windows).join(windows.select("conv_id", "window", "n_new", "n_tokens"), ["conv_id", "window"]).collect():
        own = [t for t in r["turns"] if not t["again"]]
        total = sum(map(size, r["turns"]))
        assert total == r["n_tokens"] and len(own) == r["n_new"] > 0 and (total <= budget or len(own) == 1 and all(t["role"] == "system" for t in r["turns"] if t["again"])), r
        assert sum(size(t) for t in r["turns"] if t["again"] and t["role"] != "system") <= history
        seen[r["conv_id"]] += len(own)
    assert seen == collections.Counter(x["conv_id"] for x in d.collect())


# 4


def test_line_dedup_odd(spark):
    got = line_dedup.dedup_lines(docs(spark), batches=3).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert len(got) == docs(spark).count()
    of = {r["doc_id"]: r for r in got}
    assert of[1]["n_lines"] == 1 and of[1]["kept_text"] == "" and of[3]["n_lines"] == 2 and of[6]["n_dropped"] == 1 and of[None]["n_dropped"] == 1
    assert of[2**40]["n_dropped"] == 0 and of[7]["n_dropped"] == 0
    assert line_dedup.dedup_lines(no_docs(spark)).count() == 0


def test_line_runs_know_first_batches(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for b in ([(1, 1, 2, 90), (2, 2, 1, 80)], [(1, 1, 1, 70)], [(1, 1, 5, 60), (3, 3, 1, 50)]):
        runs.add(spark.createDataFrame(b, "h1 long, h2 long, n_docs long, keeper long"))
    assert [len(level) for level in runs.levels] == [1, 1]
    held = [tuple(r) for name in runs.runs() for r in spark.table(name).collect()]
    assert sorted(held) == [(1, 1, 90), (2, 2, 80), (3, 3, 50)]
    assert sorted(tuple(r) for r in runs.close().collect()) == [(1, 1, 8, 90), (2, 2, 1, 80), (3, 3, 1, 50)]


def test_runs_are_joined_as_they_lie(spark):
    runs = line_dedup.LineRuns(spark)
    rows = spark.range(1000).selectExpr("xxhash64(id % 400) AS h1", "id % 400 AS h2", "id")
    for least, most in ((500, 1000), (0, 500)):
        runs.add(rows.where(f"id >= {least} and id < {most}").groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("id").alias("keeper")))
        if least:
            batch, first = spark.table(runs.batches[0]), spark.table(runs.runs()[0])
            with common.setting(spark, line_dedup.IN_ORDER, "true"):
                plan = batch.join(first.hint("merge"), line_dedup.KEY, "left_anti")._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    got = runs.close()
    assert got.count() == 400 and got.where("keeper < 600 or keeper % 400 <> h2").count() == 0


def test_common_lines_are_broadcast(spark, monkeypatch):
    marks = spark.range(900).selectExpr("IF(id < 500, 1, id % 40 + 2) AS h1", "1L AS h2", "id AS rid")
    keys = marks.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("rid").alias("keeper"))
    want = sorted(tuple(r) for r in marks.join(keys.drop("n_docs"), ["h1", "h2"]).collect())
    for hot in (1, 10, 10_000):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        assert sorted(tuple(r) for r in line_dedup.lines_with(marks, keys).collect()) == want


# 5


def test_language_held_out(spark):
    got = queries.queries()["op5_langid"](spark, SF).join(table(spark, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 30 and (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_odd(spark):
    model = langid.fit(table(spark, "documents"), langid.default_vocab())
    got = {r["doc_id"]: r for r in langid.predict(docs(spark), model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3, 9))
    assert got[4]["lang_pred"] != "und" and got[10]["lang_pred"] != "und"
    assert langid.predict(no_docs(spark), model).count() == 0
    kept = langid.identified(docs(spark), model)
    assert kept.columns == docs(spark).columns and {1, 2, 3, 9}.isdisjoint(r["doc_id"] for r in kept.collect())
    # a word that two languages share is less sure than a text
    few = spark.createDataFrame([(1, "Re."), (2, table(spark, "documents").where("lang = 'fr'").first()["text"])], "doc_id long, text string")
    short, long = [r["score"] for r in langid.predict(few, model).orderBy("doc_id").collect()]
    assert short < 0.95 < long
    none = langid.fit(no_docs(spark).withColumn("lang", F.lit("en")), langid.default_vocab())
    assert {r["lang_pred"] for r in langid.predict(docs(spark), none).collect()} == {"und"}


def test_forward_sums_all_cuts():
    """Every way to cut a word is listed; long words are summed by blocks."""
    pieces = langid.loaded(langid.default_vocab())
    r = np.random.default_rng(0)
    prob = np.vstack([r.random((pieces.n, 2)) / 20, np.zeros((1, 2))])

    def piece(text):
        ids = pieces.ids(langid.places([text[1:]], len(text) - 1) if text[0] == langid.START else np.array([[ord(c) for c in text]]))
        return int(ids[len(text) - 1][0, 0]) if len(text) <= len(ids) else -1

    word = "internation"
    text, total = langid.START + word, np.zeros(2)
    for cut in itertools.product([False, True], repeat=len(text) - 1):
        ends = [i + 1 for i, c in enumerate(cut) if c] + [len(text)]
        found = [piece(text[a:z]) for a, z in zip([0, *ends], ends, strict=False)]
        total += np.prod([prob[p] for p in found], axis=0) if min(found) >= 0 else 0
    assert np.exp(langid.word_scores([word], pieces, prob)[0]) == pytest.approx(total)
    long = "donaudampfschifffahrtsgesellschaft" * 9
    alpha = langid.forward(pieces.ids(langid.places([long], len(long))), prob)
    assert langid.word_scores([long], pieces, prob)[0] == pytest.approx(np.log(alpha[-1, 0]) - (len(long) + 1) * np.log(langid.SCALE))
    assert pieces.longest > 10 and langid.words_of("½ ² Ⅷ 12_3") == [] and langid.words_of("m² Été") == ["m", "été"]


# 6

ITEM = "A train leaves Paris and travels 60 km in 2 hours while the other train from Paris covers 60 km in 3 hours on the same long track."


def test_leaks(spark):
    short = "Name the capital"
    other = "If Maria buys 12 apples and Tom buys 30 pears, how many pieces of fruit do they have together?"
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, "1 2 3 4 5 6 7 8 9 10"), (4, short), (5, ""), (6, other), (6, other)], "item_id long, text string")
    same = ITEM.replace("60", "75").replace("Paris", "Berlin")
    mixed = ITEM.replace("60", "75", 1).replace(" 2 ", " 7 ").replace("from Paris", "from Oslo")
    rows = [
        (1, "Intro words here. " + ITEM + " And more."), (1, "Intro words here. " + ITEM + " And more."), (2, same), (3, mixed), (4, " ".join(ITEM.split()[:12])), (5, None), (6, ""), (7, "9 8 7 6 5 4 3 2 1 " * 50),
        (8, "Please: name the capital!"), (9, "Name a capital"), (10, "0, 1 2 3 4 5 6 7 8 9 10"), (11, ITEM.lower()), (12, ITEM.upper()), (13, "Maria went home.\n" + other.replace("Maria", "Ada").replace("12", "7")),
        (14, ITEM + " " + same + " " + mixed), (15, "x " * 40_000 + same + " y" * 40_000), (None, other), (16, same.replace("Berlin", "New York")),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("item", "doc", "h", "row", "occ", "toks", "w", "item_id"):
        d = d.withColumn(c, F.lit(0))
    found = decontaminate.find_leaks(d, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 1), (2, 1), (8, 4), (10, 3), (11, 1), (12, 1), (13, 6), (14, 1), (15, 1), (None, 6)}
    assert len(found) == 10
    assert decontaminate.find_leaks(d.limit(0), items).count() == 0 and decontaminate.find_leaks(d, items.limit(0)).count() == 0


def leaks_by_force(docs, items, window=5, similarity=0.8):
    """Every window of every item at every place of every text; occurrences by the places where the item would begin."""

    def toks(text):
        t = re.sub(r"(\d)[.,](?=\d)", r"\1", text)
        t = re.sub(rf"(\d)[ -]*((?i:{'|'.join(decontaminate.UNITS)}))(?![^\W_])", "\\1 \x02\\2", t)
        t = re.sub(r"(\d)(?=[^\W\d_])", r"\1 ", t)
        t = "".join("\x01" + c if c.isupper() and n.islower() else c for c, n in zip(t, t[1:] + " ", strict=True))
        return [x for x in re.split(r"[^\w\x01\x02]+|_+", t.lower()) if x]

    kind = lambda t: t[0] if t[0] in "\x01\x02" else "0" if t[0].isdigit() else t
    out = set()
    texts = {i: toks(t) for i, t in docs}
    where = {i: collections.defaultdict(list) for i in texts}
    for i, t in texts.items():
        for p in range(len(t) - window + 1):
            where[i][tuple(map(kind, t[p : p + window]))].append(p)
    for k, text in items:
        own = toks(text)
        places = [p for p in range(len(own) - window + 1) if sum(x[0] > ":" for x in own[p : p + window]) >= 2]
        for i, t in texts.items():
            met = sorted((d - p, d, p) for p in places for d in where[i].get(tuple(map(kind, own[p : p + window])), ()))
            if len({p for _, _, p in met}) < similarity * len(places):
                continue
            groups = []
            for m in met:
                if not groups or m[0] - groups[-1][-1][0] > min(8, len(places)):
                    groups.append([])
                groups[-1].append(m)
            for g in groups:
                slots = lambda d, p: [(a, b) for a, b in zip(own[p : p + window], t[d : d + window], strict=True) if a[0] < ":"]
                seen = collections.Counter(s for _, d, p in g for s in slots(d, p))
                usual = {}
                for (a, b), n in seen.items():
                    usual[a] = max(usual.get(a, (0, "")), (n, b))
                if len({p for _, d, p in g if all(usual[a][1] == b for a, b in slots(d, p))}) >= similarity * len(places):
                    out.add((i, k))
    return out


def test_leaks_by_force(spark):
    """All documents against all items, and re-parameterised items planted in them."""
    d, b = (table(spark, t).toPandas() for t in ("documents", "benchmark"))
    rng = np.random.default_rng(4)
    rows = [(int(i), t or "") for i, t in zip(d.doc_id, d.text, strict=True)]
    for n, t in enumerate(b.text[:20]):
        other = re.sub(r"\d+", lambda m: str(rng.integers(10, 99)) if n % 2 else "4711", t)
        rows.append((10_000 + n, rows[n][1][:500] + "\n" + other + "\n" + rows[n][1][500:900]))
    items = [(int(i), t) for i, t in zip(b.item_id, b.text, strict=True)]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), table(spark, "benchmark")).collect()}
    assert got == leaks_by_force(rows, items) and len(got) > 5


def test_leaks_in_documents(spark):
    d, b = (table(spark, t).toPandas() for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in queries.queries()["op6_decontaminate"](spark, SF).collect()}
    assert got >= {(int(i), int(k)) for k, t in zip(b.item_id, b.text, strict=True) for i, x in zip(d.doc_id, d.text, strict=True) if t in x}


# 7


def test_fingerprints(spark):
    d = table(spark, "documents").select("doc_id", "text")
    t = d.orderBy("doc_id").toPandas()
    got = queries.queries()["op7_spotsigs"](spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    texts = list(t.text)
    for i, x in enumerate(texts):
        k, nxt = len(x) // 4, texts[(i + 1) % len(texts)]
        assert got.edited_sha256[i] == hashlib.sha256((x[: len(x) - k] + nxt[:k]).encode()).hexdigest() and got.n_chars[i] == len(x)
    assert got.near_edited.median() > 0.5 and got.near_next.median() < 0.02
    alone = spotsigs.fingerprints(d).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (alone.fingerprint == got.fingerprint).all()


def test_fingerprints_odd(spark):
    got = spotsigs.compare_edited(docs(spark)).collect()
    assert len(got) == docs(spark).count()
    of = {r["doc_id"]: r for r in got}
    assert of[4]["fingerprint"] == of[5]["fingerprint"] != "" and of[1]["fingerprint"] == "" and of[4]["near_next"] == 1
    assert spotsigs.compare_edited(no_docs(spark)).count() == 0
    assert spotsigs.compare_edited(docs(spark).where("doc_id = 4")).first()["near_next"] == 1


# 8


def test_bpe_is_exact(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(bpe.default_vocab())
    texts = [r["text"] for r in table(spark, "documents").select("text").collect()]
    r = np.random.default_rng(0)
    texts += ["", "<|endoftext|>a <|endoftext|><|endoftext|", "it's I'LL 'S  \n\n\tx", "日本語🎉é́", "a" * 3000, " " * 2000, "!?" * 900, "x\x00\x1c "]
    texts += ["".join(r.choice(list("abcdetionhrs \né1,.'"), 300)) for _ in range(50)] + ["".join(map(chr, r.integers(1, 0x2FFF, 60))) for _ in range(50)]
    own = bpe.loaded(bpe.default_vocab())
    for t, e in zip(texts, reference.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = own.encode(t)
        assert list(ids) == e.ids and own.decode(ids) == reference.decode(e.ids, skip_special_tokens=False)


def test_bpe_odd(spark):
    got = bpe.encode_documents(docs(spark), bpe.default_vocab()).collect()
    of = {r["doc_id"]: r for r in got}
    assert len(got) == docs(spark).count() and list(of[1]["ids"]) == [] == list(of[2]["ids"]) and of[8]["decoded"] == "héllo\x00wörld 你好"
    assert bpe.encode_documents(no_docs(spark), bpe.default_vocab()).count() == 0


# 9


def test_toxicity_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    got = queries.queries()["op9_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    hit = ((held.predicted == 1) & (held.toxic == 1)).sum()
    assert hit / held.predicted.sum() > 0.85 and hit / held.toxic.sum() > 0.6 and got.score.between(0, 1).all()


def drawn_votes(n=6000, seed=3):
    """Votes of known accuracy; the third voter mostly repeats the second."""
    r = np.random.default_rng(seed)
    side = (r.random(n) < 0.3).astype(float)
    fire = lambda hit, miss: r.random(n) < np.where(side > 0, hit, miss)
    votes = np.stack([fire(0.8, 0.1), fire(0.7, 0.2), np.zeros(n, bool), fire(0.6, 0.05), fire(0.75, 0.15)], 1)
    votes[:, 2] = np.where(r.random(n) < 0.9, votes[:, 1], fire(0.5, 0.5))
    return side, votes.astype(np.uint8), np.where(r.random(n) < 0.15, 1 - side, side)


def test_votes_are_weighed_with_their_parents():
    side, votes, _ = drawn_votes(300)
    p, parent = 0.1 + 0.8 * side, np.array([-1, 0, 1, -1, 3])
    want = np.zeros(len(votes))
    for sign, w in ((1, p), (-1, 1 - p)):
        for j, k in enumerate(parent):
            prior = (votes[:, j].sum() + 0.5) / (len(votes) + 1)
            for i, row in enumerate(votes):
                alike = [m for m in range(len(votes)) if k < 0 or votes[m, k] == row[k]]
                rate = (sum(w[m] for m in alike if votes[m, j]) + prior) / (sum(w[m] for m in alike) + 1)
                want[i] += sign * np.log(rate if row[j] else 1 - rate)
    assert toxicity.log_odds(votes, p, parent) == pytest.approx(want)


def test_label_model_finds_sides_and_dependences():
    side, votes, gold = drawn_votes()
    posterior, parent = toxicity.label_model(votes, gold)
    assert parent[2] == 1 or parent[1] == 2
    assert (parent[[0, 3, 4]] < 0).all()
    # better than the gold labels that it starts from, 15 per cent of which are wrong
    assert ((posterior > 0.5) == side).mean() > 0.9 > (gold == side).mean()


def test_toxicity_odd(spark):
    model = toxicity.fit(table(spark, "documents"), table(spark, "labels"))
    got = toxicity.score(docs(spark), model).collect()
    assert len(got) == docs(spark).count() and all(0 <= r["score"] < 0.3 for r in got if r["doc_id"] in (1, 2, 3))
    assert toxicity.score(no_docs(spark), model).count() == 0
    blank = toxicity.fit(table(spark, "documents"), table(spark, "labels").limit(0))
    assert {r["score"] < 0.3 for r in toxicity.score(docs(spark), blank).collect()} == {True}


# 10

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Home</li></ul></nav>
<div class="cookie-notice">We use cookies</div><main><h1>Big &amp; small</h1><p>First   line<br>goes&nbsp;on</p><div class="ad-slot sponsored">Buy</div>
<p>Second <b>bold</b> &lt;tag&gt;<script>var x = "</p>";</script></p><form><input><label>Mail</label></form><aside>Side</aside><section id="comments"><p>nice</p></section><p>Last</main><footer>&copy;</footer></body></html>"""


def test_pages(spark):
    rows = [(1, "http://a/x", PAGE), (2, None, None), (3, "http://a/y", ""), (4, "http://a/z", "plain & text"), (1, "http://a/x", PAGE)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("row", F.lit(1)).withColumn("text", F.lit("t")).withColumn("host", F.lit("h"))
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(d).collect()))
    text = "Big & small\n\nFirst line goes on\n\nSecond bold <tag>\n\nLast"
    assert got == [(1, text, len(text)), (1, text, len(text)), (2, "", 0), (3, "", 0), (4, "plain & text", 12)]
    assert html_text.extract(d.limit(0)).count() == 0


def test_frames_of_a_host_go(spark):
    page = lambda i: f"<html><body><div>My Site</div><div>Top stories</div><p>Unique text {i} here</p><p>And {i} more</p><div>Copyright</div></body></html>"
    rows = [(i, f"http://a.com/{i:03d}", page(i)) for i in range(40)] + [(99, "http://b.com/", page(99))]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Unique text {i} here\n\nAnd {i} more" for i in range(40)) and got[99].startswith("My Site")


def test_open_blocks_in_articles(spark):
    """Names that only hold a word of frames: text stays, what neighbours share and lists of links go."""
    page = lambda i: f"""<html><body><nav>Menu</nav><article><h1>Title {i}</h1><p class="social-history">Social history of town {i}</p>
<div class="related-work">Work {i} that is related</div><p>Energy <math>E = m{i}</math> holds</p><div class="share-buttons">Share this page</div>
<div class="related-links"><a href="/a">One story {i}</a> <a href="/b">Another {i}</a></div><div class="notice">Old notice {i}</div><p>Shared quotation</p></article></body></html>"""  # noqa: E731
    rows = [(i, f"http://a.com/{i:03d}", page(i)) for i in range(7)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(7):
        assert got[i].split("\n\n") == [f"Title {i}", f"Social history of town {i}", f"Work {i} that is related", f"Energy E = m{i} holds", "Shared quotation"]


def test_copies_of_a_page_are_no_frame(spark):
    page = "<html><body><div>Site</div><p>The one text of both</p></body></html>"
    rows = [(i, f"http://a.com/{i}", page) for i in range(2)]
    got = {r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {"Site\n\nThe one text of both"}


def test_common_places_at_every_length():
    """One early line more must not shift lines that stand in both more than a thousand times."""
    lines = [7] * 1100
    for i in range(0, 1100, 3):
        lines[i] = 1000 + i
    more = [7] + lines
    many = [7] * 1001 + list(range(5000, 5300))
    assert len(html_text.common_places(lines * 2, more * 2)) == 2200
    assert len(html_text.common_places(many, [7, 9] + many)) == len(many)
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = (rng.integers(0, rng.integers(1, 9), rng.integers(0, 30)).tolist() for _ in "ab")
        row = [0] * (len(b) + 1)
        for x in a:
            row, was = [0], row
            for j, y in enumerate(b):
                row.append(was[j] + 1 if x == y else max(was[j + 1], row[j]))
        got = html_text.common_places(a, b)
        rest = iter(b)
        assert got == sorted(set(got)) and len(got) == row[-1] and all(a[i] in rest for i in got)


def test_article_texts(spark):
    p = table(spark, "pages").toPandas()
    got = {r["page_id"]: r["text"] for r in queries.queries()["op10_html"](spark, SF).collect()}
    import html

    for i, page in zip(p.page_id, p.html, strict=True):
        body = re.search(r"<article>(.*)</article>", page, re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub("</?b>", "", x)).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert got[i] == "\n\n".join(x for x in parts if x)
