"""N-gram Jaccard join, fingerprints, quotation linking: brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

from passforge.llm import chat, components, lzprint, ngramjoin
from llm_docs import SCHEMA, awkward, empty, frame


def brute(rows, words=4, percent=85):
    sets, up = {}, {}
    for i, t in rows:
        w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
        sets[i] = frozenset(tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()
        up[i] = i

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    ids = list(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(2000)]

    def edit(words, k):
        words = list(words)
        for _ in range(k):
            j = rng.randrange(len(words))
            r = rng.random()
            if r < 0.6:
                words[j] = rng.choice(vocab)
            elif r < 0.8 and len(words) > 1:
                del words[j]
            else:
                words.insert(j, rng.choice(vocab))
        return " ".join(words)
    texts = []
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 5, 30, 80]))]
        texts += [edit(base, rng.choice([0, 0, 1, 1, 2, 3])) for _ in range(rng.choice([1, 2, 3, 6]))]
    big = [rng.choice(vocab) for _ in range(150)]
    texts += [edit(big, rng.choice([0, 1, 2, 3, 4])) for _ in range(90)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    texts += [" ".join(rng.choice(vocab) for _ in range(rng.choice([5, 10, 40]))) + " " + passage for _ in range(60)]
    texts += [None, "", " \n", "One two", "one TWO", "x" * 30000]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_join_components_against_all_pairs(spark):
    rows = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in ngramjoin.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_links_inside_a_group_beyond_its_head(spark):
    rng = random.Random(9)
    texts = []
    for t in range(80):  # y links with x and with h, x not with h; often all three have one prefix that no other has
        y = [f"w{t}x{rng.randrange(10**6)}" for _ in range(16)]
        texts += [" ".join(w) for w in (y, [*y[:-1], "last"], ["first", *y[1:]])]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute(rows)
    assert len({c for _, c in want.values()}) == 80
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.join_components(df).collect()} == want


def test_keep_one_and_other_parameters(spark):
    rows = near_copies(6)
    want = {i for i, (_, c) in brute(rows, 5, 80).items() if i == c}
    kept = ngramjoin.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert Counter(r.doc_id for r in kept) == Counter(want)


def test_join_awkward_and_empty(spark):
    got = ngramjoin.join_components(frame(spark)).collect()
    assert len(got) == len(awkward())
    assert all(r.n_shingles > 0 or r.component_id == r.doc_id for r in got)
    assert ngramjoin.join_components(empty(spark)).count() == 0
    assert ngramjoin.keep_one(frame(spark)).columns == frame(spark).columns


def test_keep_one_names_documents_by_id_and_text(spark):
    rng = random.Random(8)
    text = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    other = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    t, tx, ty = (" ".join(text + more) for more in ([], ["x"], ["y"]))
    rows = [(1, t), (2, tx), (2, other), (7, t + " p q"), (7, ty), (8, other), (9, None), (9, ""), (9, None)]
    kept = ngramjoin.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert Counter(map(tuple, kept)) == Counter([(1, t), (2, other), (9, None), (9, ""), (9, None)])
    both = [(3, t), (3, tx), (3, ty), (4, other)]  # near copies under one id: one of them stays
    kept = ngramjoin.keep_one(spark.createDataFrame(both, "doc_id long, text string"), 5, 80).collect()
    assert sorted(r.doc_id for r in kept) == [3, 4] and (4, other) in map(tuple, kept)


def test_shared_shingles_are_found_whatever_the_flags(spark, monkeypatch):
    rows = [(i, " ".join(f"a{i}x{k}" for k in range(20)) + " one two three four five six") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).select("text")
    want, n = ngramjoin.hot_shingles(df, 4)
    assert len(want) == 3 and n.min() >= 39
    monkeypatch.setattr(ngramjoin, "BLOCK", 10)
    again, _ = ngramjoin.hot_shingles(df, 4)
    assert set(want) <= set(again)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (100, 101)], "a long, b long")
    got = {r.node: r.label for r in components.components(links).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 102: 100}


def plain_phrases(data):
    seen, out, i = set(), [], 0
    while i < len(data):
        k = 1
        while data[i:i + k] in seen and i + k < len(data):
            k += 1
        seen.add(data[i:i + k])
        out.append(data[i:i + k])
        i += k
    return out


def test_phrases_and_likeness():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("abé ") for _ in range(rng.randint(0, 200)))
        assert lzprint.phrases(text) == plain_phrases(text.encode())
    a, b = ("".join(rng.choice("abcdefghij klm") for _ in range(6000)) for _ in range(2))
    sa, sb, mixed = map(lzprint.signature, (a, b, a[:3000] + b[:3000]))
    true = lambda x, y: len(set(lzprint.phrases(x)) & set(lzprint.phrases(y))) / len(set(lzprint.phrases(x)) | set(lzprint.phrases(y)))
    assert abs(lzprint.likeness(sa, mixed) - true(a, a[:3000] + b[:3000])) < 0.2
    assert lzprint.likeness(sa, sa) == 1 and lzprint.likeness(sa, mixed) > lzprint.likeness(sa, sb)


def test_compare_with_next_against_a_loop(spark):
    rows = [r for r in awkward() if r[0] is not None][:-2]
    for ranges in (1, 5):
        got = {r.doc_id: r for r in lzprint.compare_with_next(spark.createDataFrame(rows, SCHEMA), ranges=ranges).collect()}
        order = sorted(rows, key=lambda r: -r[0])
        assert len(got) == len(order)
        for k, (i, t, *_) in enumerate(order):
            t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
            half = len(t) // 2
            edited = t[:len(t) - half] + nxt[:half]
            r = got[i]
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            a, b, c = map(lzprint.signature, (t, edited, nxt))
            assert (r.fingerprint, r.edited_fingerprint) == (lzprint.as_text(a), lzprint.as_text(b))
            assert (r.near_edited, r.near_next) == (lzprint.likeness(a, b), lzprint.likeness(a, c))


def test_compare_awkward(spark):
    assert lzprint.compare_with_next(frame(spark)).count() == len(awkward())  # null and repeated ids too
    assert lzprint.compare_with_next(empty(spark)).count() == 0
    one = lzprint.compare_with_next(frame(spark, awkward()[:1])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_split_quotes():
    own, quotes = chat.split_quotes("Hi,\n\nOn Monday Ann wrote:\n> a question\n> in two lines\n>> older\n\nmy answer")
    assert own == "Hi,\n\nmy answer"
    assert quotes == [(1, "a question\nin two lines"), (2, "older")]


def brute_links(rows):
    """Parent by the definition, for one table of (conv, turn, role, text)."""
    out = {}
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    for conv, msgs in by.items():
        parsed = {r: chat.split_quotes(r[3] or "") for r in msgs}
        first = {}
        for r in sorted(msgs, key=lambda x: x[1]):
            for h in chat.units(parsed[r][0]):
                first.setdefault(h, r)
        for r in msgs:
            score = Counter()
            for level, q in parsed[r][1]:
                for h, n in chat.units(q).items():
                    if h in first and first[h][1] < r[1]:
                        score[(-level, first[h])] += n
            best = max(score, key=lambda k: (k[0], score[k], k[1][1]), default=None)
            out[r] = best[1][1] if best else None
        for r in msgs:
            at = r
            while out[at] is not None:
                at = next(m for m in msgs if m[1] == out[at])
            out[(r, "root")] = at[1]
    return out


def test_link_quotes(spark):
    rng = random.Random(8)
    rows = []
    for conv in range(12):
        said = []
        for turn in range(rng.randint(1, 9)):
            text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randint(0, 99)) for _ in range(12))
            full = text
            if said and rng.random() < 0.6:
                k = rng.randrange(len(said))
                full = f"X wrote:\n> {said[k]}\n\n{text}"
                if k and rng.random() < 0.4:
                    full = f"> {said[k]}\n>> {said[k - 1]}\n{text}"
            said.append(text)
            rows.append((conv, turn, rng.choice(["user", "assistant"]), full))
    want = brute_links(rows)
    df = spark.createDataFrame(rows + rows[:2], "conv_id long, turn long, role string, text string")
    got = chat.link_quotes(df).collect()
    assert len(got) == len(rows)
    text = {(r[0], r[1]): r for r in rows}
    order = defaultdict(list)
    for r in got:
        src = text[(r.conv_id, r.turn)]
        assert r.parent_turn == want[src] and r.root_turn == want[(src, "root")]
        assert ">" not in r.own and r.formatted.startswith(f"<|{r.role}|>\n{r.own}")
        order[r.conv_id].append((r.position, r.turn, r.parent_turn))
    for rows_ in order.values():
        assert [p for p, *_ in sorted(rows_)] == list(range(1, len(rows_) + 1))
        assert [turn for _, turn, _ in sorted(rows_)] == reply_order({turn: parent for _, turn, parent in rows_})


def reply_order(parents):
    """Messages, each followed by its replies with all that follows from them."""
    out = []

    def visit(turn):
        out.append(turn)
        for t in sorted(parents):
            if parents[t] == turn:
                visit(t)
    for t in sorted(parents):
        if parents[t] is None:
            visit(t)
    return out


def test_replies_stand_behind_their_message_in_long_threads(spark):
    rng = random.Random(31)
    said, parents, rows = {}, {}, []
    for turn in range(400):
        said[turn] = " ".join(f"word{rng.randrange(10**6)}" for _ in range(8))
        parents[turn] = None if turn == 0 or rng.random() < 0.05 else rng.choice([turn - 1, rng.randrange(turn)])
        quote = "" if parents[turn] is None else "Ann wrote:\n" + f"> {said[parents[turn]]}\n\n"
        rows.append((5, turn, "user", quote + said[turn]))
    rng.shuffle(rows)
    got = chat.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.turn: r.parent_turn for r in got} == parents
    assert [r.turn for r in sorted(got, key=lambda r: r.position)] == reply_order(parents)
    assert all(r.own == said[r.turn] for r in got)


def test_sibling_replies(spark):
    rows = [(1, 0, "user", "opening words of it"), (1, 1, "user", "> opening words of it\nfirst reply here"),
            (1, 2, "user", "> opening words of it\nsecond reply here"), (1, 3, "user", "> first reply here\nanswer to the first")]
    got = chat.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [r.turn for r in sorted(got, key=lambda r: r.position)] == [0, 1, 3, 2]


def test_short_messages_quoted_whole(spark):
    said = ["Why?", "> why?\nBecause of rain", "> Why?\n> \nI agree", "> I agree\nOk", "> no\nwhat", "> ok\nYes."]
    rows = [(1, t, "user", x) for t, x in enumerate(said)]
    got = {r.turn: (r.parent_turn, r.root_turn)
           for r in chat.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: (None, 0), 1: (0, 0), 2: (0, 0), 3: (2, 0), 4: (None, 4), 5: (3, 0)}


def test_link_quotes_awkward(spark):
    rows = [(None, None, None, None), (None, 1, "user", "> lost quote here\nhello"), (1, None, "user", "first words here"),
            (1, 0, None, "> first words here\nyes"), (1, 0, "user", ""), (1, 0, "user", "")]
    got = chat.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 5
    assert chat.link_quotes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
