import numpy as np
import pytest

from geohotspots.llm import line_dedup as q
from geohotspots.llm.pigeonhole import spanning_links

BASE = "the quick brown fox jumps over the lazy dog and runs far away into the dark wood number {} where nobody was seen before"


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_simhash(line):
    codes = {int(q.word_hashes(w)[0][0]) for w in q.normal_line(line).split(" ")}
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def brute_surplus(docs):
    """Dropped (document, line) pairs by comparing all pairs of distinct lines."""
    first, places = {}, {}
    for doc, text in docs:
        for no, line in enumerate((text or "").split("\n")):
            if normal := q.normal_line(line):
                places.setdefault(normal, []).append((doc, no))
                first.setdefault(normal, brute_simhash(line))
    names = sorted(places)
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if (first[a] ^ first[b]).bit_count() <= q.RADIUS and lev(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9):
                root[find(a)] = find(b)
    groups = {}
    for n in names:
        groups.setdefault(find(n), []).extend(places[n])
    return {p for g in groups.values() for p in g if p != min(g)}


@pytest.mark.parametrize("seed", range(3))
def test_edit_distance(seed):
    rng = np.random.default_rng(seed)
    for _ in range(150):
        a = "".join(rng.choice(list("abc"), rng.integers(0, 60)))
        b = list(a)
        for _ in range(rng.integers(0, 8)):
            k = int(rng.integers(0, len(b) + 1))
            b[k : k + int(rng.integers(0, 2))] = rng.choice(list("abc"), rng.integers(0, 2)).tolist()
        b = "".join(b)
        for most in (0, 1, 3, 6, 20):
            assert q.edit_distance_within(a, b, most) == (lev(a, b) <= most)


def test_simhash_of_long_and_short_lines():
    text = "a bc " * 40_000 + "\nOne, two-three 44!\n--\n"
    got = q.line_prints([text])
    assert got["at"][0].tolist() == [0, 1]
    assert [int(x) for x in got["fp"][0].view(np.uint64)] == [brute_simhash(x) for x in text.split("\n")[:2]]


def test_word_hashes_follow_normal_lines():
    text = "Ab 12x3 c-D \n\n ÉÜ 漢字 aB; ab 45x6\n--\n" + "w" * 300_000 + "\nEnd"
    hashes, lines = q.word_hashes(text)
    words = [(no, w) for no, line in enumerate(text.split("\n")) for w in q.normal_line(line).split(" ") if w]
    assert lines.tolist() == [no for no, _ in words]
    seen = {}
    for h, (_, w) in zip(hashes.tolist(), words):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen) == len({w for _, w in words})


def test_spanning_links_connect_like_all_pairs():
    rng = np.random.default_rng(1)
    fps = []
    for base in rng.integers(0, 1 << 63, 15, dtype=np.uint64):
        for _ in range(15):
            x = int(base)
            for bit in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(bit)
            fps.append(x)
    fps = np.unique(np.array(fps, np.uint64))
    rng.shuffle(fps)
    groups = np.sort(rng.integers(0, 3, len(fps)))

    def parts(pairs):
        root = list(range(len(fps)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        return [find(i) for i in range(len(fps))]

    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 4
    everything = [(i, j) for i, j in zip(*np.nonzero(near)) if groups[i] == groups[j]]
    assert parts(everything) == parts(zip(*spanning_links(fps, groups, 4)))


def test_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    docs = []
    for i in range(60):
        lines = []
        for _ in range(4):
            line = BASE.format(rng.integers(0, 5)) + " " + " ".join(f"w{k % 7}x" for k in rng.integers(0, 400, 30))
            if rng.random() < 0.5:
                line = BASE.format("many") * 2
            if rng.random() < 0.4:
                at = int(rng.integers(0, len(line)))
                line = line[:at] + "Q" + line[at + 1 :]
            lines.append(line)
        docs.append((i, "\n".join([*lines, "--", "same words differ", "differ same words"])))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc"], n) for r in q.surplus_lines(frame.repartition(5)).collect() for n in r["dropped"]}
    assert got == brute_surplus(docs)
    texts = {r["doc_id"]: r["text"] for r in q.dedup_lines(frame).collect()}
    for doc, text in docs:
        kept = [x for n, x in enumerate(text.split("\n")) if (doc, n) not in got]
        assert texts[doc] == "\n".join(kept)


def test_odd_rows(odd_docs, no_docs):
    out = q.dedup_lines(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    by_id = {r["doc_id"]: r for r in out.filter("doc_id is not null").collect()}
    assert by_id[0]["text"] is None and by_id[1]["text"] == "" and by_id[100]["n_chars"] == len(by_id[100]["text"])
    assert by_id[100]["text"].startswith("The same") and by_id[119]["text"] == ""
    assert q.line_report(odd_docs).count() == odd_docs.count()
    assert q.dedup_lines(no_docs).count() == 0 and q.line_report(no_docs).count() == 0


def test_rows_without_an_id_or_with_a_shared_one_keep_their_own_lines(spark):
    shared = "this line stands in many of the rows here"
    texts = {
        "a": f"first of a\n{shared}\nlast of a",
        "b": f"first of b\nsecond of b only\n{shared}",
        "c": f"{shared}\nsecond of c only",
        "d": f"first of d\n{shared}\nlast of d",
    }
    for ids in ([None] * 4, [7] * 4, [None, None, 7, 7]):
        frame = spark.createDataFrame(list(zip(ids, texts.values())), "doc_id long, text string").repartition(3)
        kept = [line for r in q.dedup_lines(frame).collect() for line in r["text"].split("\n")]
        # One occurrence of the shared line stays, and every line that occurs once.
        every = {line for t in texts.values() for line in t.split("\n")}
        assert sorted(kept) == sorted(every)
        assert sum(r["n_dropped"] for r in q.line_report(frame).collect()) == 3
