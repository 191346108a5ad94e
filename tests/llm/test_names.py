import random

from lorequarry.llm.names import Trie, allowed, index_shards, parsed, query_shards, spelling_pairs, tokens_of


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_trie_and_shards_enumerate_all_neighbours():
    rng = random.Random(2)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(4, 9))) for _ in range(150)}
    trie = Trie()
    for w in words:
        trie.add(w)
    for q in ["".join(rng.choice("abc") for _ in range(rng.randint(4, 9))) for _ in range(60)]:
        want = {(w, osa(q, w)) for w in words if osa(q, w) <= 2}
        assert set(trie.near(q, 2)) == want
        assert all(set(index_shards(w)) & set(query_shards(q)) for w, d in want if d <= min(allowed(len(w)), allowed(len(q) + 1)))


def test_shards_hold_two_edits_with_transpositions():
    rng = random.Random(9)
    for _ in range(4000):
        word = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 14)))
        seen = list(word)
        for _ in range(rng.randint(1, allowed(len(word)))):
            at, kind = rng.randrange(len(seen) - 1), rng.randrange(5)
            if kind < 2:
                seen[at], seen[at + 1] = seen[at + 1], seen[at]
            else:
                seen[at : at + (kind > 2)] = [] if kind == 4 else [rng.choice("abcxyz")]
        seen = "".join(seen)
        if osa(seen, word) <= min(allowed(len(word)), allowed(len(seen) + 1)):
            assert set(index_shards(word)) & set(query_shards(seen)), (word, seen)


def test_tokens():
    assert tokens_of("Vólt-mere, Anna the Elder") == ["anna", "voltmere", "elder"]
    assert tokens_of("Anna V0ltmere's") == ["anna", "voltmere"]


def test_parts():
    assert parsed(["kenneth", "roe", "elder"], [True, False, False]) == ("person", "roe", "kenneth", "elder")
    assert parsed(["voltmere", "k"], [False, False]) == ("person", "voltmere", "k", "")
    assert parsed(["bdh", "of", "voltmere"], [False] * 3) == parsed(["voltmere", "brotherhood"], [False] * 2) == ("body brotherhood", "voltmere", "", "")
    assert parsed(["edward", "ford"], [True, False])[0] == "person" and parsed(["temple", "of", "voltmere"], [False] * 3)[:2] == ("body temple", "voltmere")
    assert parsed(["edward", "james", "voltmere"], [True, True, False]) == parsed(["voltmere", "edward", "james"], [False, True, True]) != ("", "", "", "")
    assert parsed(["quaestor", "edward", "voltmere"], [False, True, False], frozenset(["quaestor"]))[:3] == ("person", "voltmere", "edward")
    assert parsed(["voltmere", "ford"], [False] * 2)[0] == parsed(["two", "kenneth", "stones"], [False, True, False])[0] == ""


def test_spellings(spark):
    same = ["Captain Edward Voltmerebrecht", "Edward Voltmerebrecht", "Ned Voltmerebrecht", "E. Voltmerebrecht", "Voltmerebrecht, Edward", "Voltmerebrecht Edward", "EDWARD VOLTMEREBRECHT", "Edward  Voltmerebrecht ", "Edward Vóltmerebrecht", "Edwrad Voltmerebrceht", "Edward Voltmere-brecht's"]
    others = ["Oliver Voltmerebrecht", "Ollie Voltmerebrecht", "House Voltmerebrecht", "Hse. Voltmerebrecht", "Edward Voltmerebrecht the Elder", "Edward Voltmerebrecht the Younger"]
    places = ["Voltmerebrecht Ford", "Port Voltmerebrecht", "two Edward stones", "Voltmerebrecht", "", " ", None]
    rows = [(a, b) for a, b in zip([*same, *others, *places], reversed([*same, *others, *places]))]
    df = spark.createDataFrame(rows + rows[:4], "subject string, object string").selectExpr("*", "subject as name", "1 as entity")
    got = {tuple(r) for r in spelling_pairs(df).collect()}
    want = {tuple(sorted((a, b))) for a in same for b in same if a != b} | {("Ollie Voltmerebrecht", "Oliver Voltmerebrecht")[::1] if "Oliver" > "Ollie" else ("Oliver Voltmerebrecht", "Ollie Voltmerebrecht"), ("House Voltmerebrecht", "Hse. Voltmerebrecht")}
    assert got == {tuple(sorted(p)) for p in want}
    assert spelling_pairs(df.limit(0)).collect() == []


def test_very_long_name(spark):
    df = spark.createDataFrame([("x" * 50_000 + " y" * 50, "Anna Roe")], "subject string, object string")
    assert spelling_pairs(df).collect() == []


def test_titles_are_learned_and_long_names_kept(spark):
    families = ["Brambleholt", "Craysthorne", "Dunwickery", "Elmsgrave", "Farrowdene", "Gorsebeck"]
    rows = [(f"Quaestor Edward {f}", f"Edward {f}") for f in families] + [("The Ancient Guild of the Nine Silver Lamps of Old Harrow Vale and Sons", "THE ANCIENT GUILD OF THE NINE SILVER LAMPS OF OLD HARROW VALE AND SONS"), ("Anna Maria Roe", "Roe Anna Maria")]
    got = {tuple(r) for r in spelling_pairs(spark.createDataFrame(rows, "subject string, object string")).collect()}
    assert {(f"Edward {f}", f"Quaestor Edward {f}") for f in families} <= got and ("Anna Maria Roe", "Roe Anna Maria") in got


def test_shards_with_many_queries_are_cut_into_cells(spark, monkeypatch):
    from lorequarry.llm import names

    words = ["edward", "edwina", "margaret", "brambleholt"]
    asked = [w[:i] + c + w[i + 1 :] for w in words for i in range(len(w)) for c in "xyz"]
    tables = [spark.createDataFrame([(w,) for w in rows], f"{c} string") for rows, c in ((asked, "query"), (words, "word"))]
    whole = {tuple(r) for r in names.trie_join(*tables).collect()}
    monkeypatch.setattr(names, "SHARD_QUERIES", 3)
    assert {tuple(r) for r in names.trie_join(*tables).collect()} == whole and len(whole) >= len(asked)


def test_words_of_bodies_are_learned(spark):
    families = ["Brambleholt", "Craysthorne", "Dunwickery", "Elmsgrave", "Farrowdene", "Gorsebeck"]
    rows = [(f"Sodality of {f}", f"Sdlty. of {f}") for f in families] + [(f"{f} Sodality", f"Edward {f}") for f in families]
    got = {tuple(r) for r in spelling_pairs(spark.createDataFrame(rows, "subject string, object string")).collect()}
    want = {p for f in families for p in ((f"Sdlty. of {f}", f"Sodality of {f}"), tuple(sorted((f"{f} Sodality", f"Sodality of {f}"))), tuple(sorted((f"{f} Sodality", f"Sdlty. of {f}"))))}
    assert got == want
