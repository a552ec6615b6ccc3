"""Near dedup and line dedup against all pairs."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationwise.llm import near_dedup
from stationwise.llm.line_dedup import LineConfig, cleaned, line_report
from stationwise.llm.links import components, linked_components, shared_buckets
from stationwise.llm.near_dedup import NearConfig, WordHashes, later_rows, near_groups, shingle_set, signature


def test_full_sets_are_made_once(spark, monkeypatch):
    """The join's null check must not run the shingles a second time."""
    rows = [(i, f"text number {i} of a few words") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = near_dedup.distinct_sets(near_dedup.signatures(docs, NearConfig(), None))
    plans, plain = {}, near_dedup.written

    def planned(frame, name, *more):
        plans[name] = frame._jdf.queryExecution().executedPlan().toString()
        return plain(frame, name, *more)

    monkeypatch.setattr(near_dedup, "written", planned)
    full = near_dedup.full_sets(docs, sets.select("node", "doc_id", "digest"), NearConfig())
    assert plans["full_sets"].split("Initial Plan")[0].count("ArrowEvalPython") == 1
    found = {r.shingles for r in full.collect()}
    assert found == {shingle_set(text, 5, WordHashes()).tobytes() for _, text in rows}


def text_of(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**9)}"
    return words


def corpus():
    rng = random.Random(3)
    rows, number = [], 0
    for _ in range(25):
        base = text_of(rng, rng.randrange(30, 400))
        for edits in (0, 0, 1, 2, 4, 9):
            rows.append((number * 7 % 1009, " ".join(edited(rng, base, edits))))
            number += 1
    hub = text_of(rng, 300)
    rows += [(2000 + i, " ".join(edited(rng, hub, 7))) for i in range(120)] + [(3000, " ".join(hub))]
    rows += [(4000, None), (4001, ""), (4002, " \t"), (4003, "one two"), (4004, "One  TWO"), (4005, "one"), (4006, "one two three")]
    rows += [(None, "one two"), (4003, "one two"), (5000, "long " * 20_000 + "tail end")]
    return rows


def sets_of(rows, words):
    out = []
    for _, text in rows:
        found = (text or "").encode().lower().split()
        k = min(words, len(found))
        out.append({tuple(found[i : i + k]) for i in range(len(found) - k + 1)} if found else set())
    return out


def joined(n, linked):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        parent[root(a)] = root(b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize(("words", "per_cent"), [(3, 85), (5, 80)])
def test_components_are_those_of_all_pairs(spark, words, per_cent):
    rows = corpus()
    sets = sets_of(rows, words)
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b]]
    roots = joined(len(rows), [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= per_cent * len(sets[a] | sets[b])])
    least = defaultdict(list)
    for (doc_id, _), r in zip(rows, roots):
        least[r].append(doc_id)
    expected = Counter(
        (doc_id, len(s), min((i for i in least[r] if i is not None), default=None)) for (doc_id, _), s, r in zip(rows, sets, roots)
    )
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    keyed = frame.withColumns({"node": F.lit("x"), "key": F.monotonically_increasing_id(), "digest": F.lit(0)})
    groups = near_groups(keyed, NearConfig(words=words, per_cent=per_cent), carry="key").cache()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in groups.collect()) == expected
    empty = sum(not s for s in sets)
    assert later_rows(groups).count() == len(rows) - empty - len({r for r, s in zip(roots, sets) if s})


def test_near_groups_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_groups(empty).count() == 0


def test_sketch_estimates_follow_the_similarity():
    config, hashes, rng = NearConfig(), WordHashes(), random.Random(5)
    base = text_of(rng, 600)
    own = signature(shingle_set(" ".join(base), 5, hashes), config)[1]
    bits = []
    for edits in (0, 5, 20, 120):
        other = signature(shingle_set(" ".join(edited(rng, base, edits)), 5, hashes), config)[1]
        bits.append(sum(bin((a ^ b) & (2**64 - 1)).count("1") for a, b in zip(own, other)))
    assert bits[0] == 0 and bits == sorted(bits) and bits[1] < config.most_bits() < bits[3]


def test_buckets_with_many_components_lose_no_link(spark):
    rng = np.random.default_rng(1)
    places = rng.permutation(1200)
    linked = {(int(a), int(b)) for a in range(1200) for b in range(a) if abs(places[a] - places[b]) == 1 and places[a] % 5}
    members = spark.range(1200).select(F.col("id").alias("node"), F.explode(F.array(F.lit(1), F.col("id") % 3 + 2)).alias("bucket"))
    members = members.select("node", F.col("bucket").cast("long"))
    links = spark.createDataFrame([(min(p), max(p)) for p in linked], "a long, b long")
    asked = []

    def verify(pairs):
        asked.append(pairs.count())
        return pairs.join(links, ["a", "b"]).withColumn("linked", F.lit(True))

    found = {r.node: r.component for r in linked_components(shared_buckets(members), verify).collect()}
    roots = joined(1200, linked)
    least = {}
    for i, r in enumerate(roots):
        least[r] = min(least.get(r, i), i)
    assert all(found.get(i, i) == least[r] for i, r in enumerate(roots))


def test_components_of_a_chain(spark):
    order = np.random.default_rng(2).permutation(300).tolist()
    links = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:])], "a long, b long")
    assert {r.component for r in components(links).collect()} == {0}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_lines_meet_all_pairs(spark, edits):
    rng = random.Random(edits)
    letters = "abcdeé "
    lines = ["".join(rng.choice(letters) for _ in range(rng.randrange(8, 40))).strip() for _ in range(60)]
    for line in lines[:40]:
        changed = list(line)
        for _ in range(rng.randrange(1, edits + 2)):
            at = rng.randrange(len(changed))
            changed[at : at + rng.randrange(2)] = rng.choice(["", "x", "yz"])
        lines.append("".join(changed))
    lines += ["same line again and again"] * 30 + ["aaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaa", "short", "shart", "", " \t "]
    rng.shuffle(lines)
    docs = [(i * 3 % 41, "\n".join(lines[i * 4 : i * 4 + 4])) for i in range(len(lines) // 4 + 1)]
    docs += [(None, "same line again and again"), (7, None), (8, ""), (9, docs[3][1]), (docs[3][0], docs[3][1])]
    config = LineConfig(max_edits=edits, least_chars=10)
    places = []
    for row, (doc_id, text) in enumerate(docs):
        for n, line in enumerate((text or "").split("\n")):
            if plain := " ".join(line.encode().split(b" ")[0:] and line.replace("\t", " ").split(" ")).strip():
                places.append(((doc_id is None, doc_id or 0, row, n), " ".join(plain.split())))
    texts = sorted({t for _, t in places})
    near = [
        (a, b)
        for a in range(len(texts))
        for b in range(a)
        if min(len(texts[a]), len(texts[b])) >= 10
        and abs(len(texts[a]) - len(texts[b])) <= edits
        and distance(texts[a], texts[b]) <= edits
    ]
    roots = dict(zip(texts, joined(len(texts), near)))
    first = {}
    for place, text in sorted(places):
        first.setdefault(roots[text], place)
    kept = Counter(place[2] for place, text in places if first[roots[text]] == place)
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).withColumn("key", F.lit(1))
    found = line_report(frame, config).collect()
    expected = Counter(
        (doc_id, sum(p[2] == row for p, _ in places), kept[row]) for row, (doc_id, _) in enumerate(docs)
    )
    assert Counter((r.doc_id, r.n_lines, r.n_kept) for r in found) == expected
    assert all(r.n_lines - r.n_kept == len([x for x in r.dropped.split(",") if x]) for r in found)


def test_short_lines_meet_all_pairs_as_in_production(spark):
    rng = random.Random(9)
    edits = LineConfig().max_edits
    lines = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzé日") for _ in range(rng.randrange(1, 7))) for _ in range(n)) for n in (1, 2, 3, 5, 8, 12) * 25]
    lines = [x for x in lines if len(x) > 4]
    for line in lines[:120]:
        changed = list(line)
        for _ in range(rng.randrange(1, edits + 2)):
            at = rng.randrange(len(changed))
            changed[at : at + rng.randrange(2)] = rng.choice(["", "x", "yz"])
        lines.append("".join(changed))
    lines += ["q" * 38, "q" * 39, "q" * 40, "q" * 41, "1234567890" * 4, "234567890" + "1234567890" * 3, "MENU", "MENÜS", "=", "==", "-"]
    plain = [" ".join(x.split()) for x in lines]
    texts = sorted(set(plain) - {""})
    near = [(a, b) for a in range(len(texts)) for b in range(a) if abs(len(texts[a]) - len(texts[b])) <= edits and distance(texts[a], texts[b]) <= edits]
    assert sum(len(texts[a]) < 40 for a, _ in near) > 40
    roots = dict(zip(texts, joined(len(texts), near)))
    rows, seen = [], set()
    expected = {}
    for i in range(0, len(lines), 3):
        rows.append((i, "\n".join([*lines[i : i + 3], "  "])))
        stay = []
        for line, key in zip(lines[i : i + 3], plain[i : i + 3]):
            if not key or roots[key] not in seen:
                stay.append(line)
            if key:
                seen.add(roots[key])
        expected[i] = "\n".join([*stay, "  "])
    rows += [(5000, None), (5001, ""), (5002, "MENU")]
    expected |= {5000: None, 5001: "", 5002: ""}
    found = cleaned(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.text for r in found} == expected


def test_lines_of_nothing(spark):
    assert line_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
