"""Problem 1: link the spellings of one person or organisation among names as people typed them.

Names are cut into tokens. Tokens are matched to much better attested ones by a trie join: tokens are sharded by length
and an exactly matching segment, each shard is a trie, and a Levenshtein automaton is run down the trie to enumerate
neighbours within a bounded distance. Names whose matched tokens agree in any order, with titles, nicknames, initials and
abbreviations of body names resolved, are spellings of one entity.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorequarry.llm.grouping import pairs_within
from lorequarry.session import cut_lineage, partitions

#: Titles before or after a person's name, with their short forms.
TITLES = "captain capt lady ldy lord ld doctor dr marshal mshl warden wdn magister mag mgr keeper kpr ser sir mister mr mrs ms miss professor prof reverend rev father brother sister".split()
#: Words of body names and their short forms: word -> what it stands for.
BODY_WORDS = {
    "house": "house", "hse": "house", "brotherhood": "brotherhood", "bhd": "brotherhood", "society": "society", "soc": "society", "saint": "saint", "st": "saint",
    "order": "order", "ord": "order", "lantern": "lantern", "lntn": "lantern", "sons": "sons", "chandlers": "chandlers", "chdlrs": "chandlers", "chndlrs": "chandlers", "chs": "chandlers", "guild": "guild", "gld": "guild", "weavers": "weavers", "wvrs": "weavers",
    "free": "free", "fr": "free", "company": "company", "co": "company", "coy": "company", "mining": "mining", "mng": "mining", "miners": "mining",
    "and": "", "of": "", "the": "", "ltd": "", "inc": "",
}
#: A body word that alone makes a name the name of a body.
BODY_KINDS = {"house", "brotherhood", "society", "order", "chandlers", "guild", "company", "mining"}
#: Words that make a name the name of a place, in first or last position.
PLACE_WORDS = "port upper lower ford keep abbey hollow bridge castle hill valley".split()
NUMBERS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred".split()
GENERATIONS = {"elder": "elder", "younger": "younger", "senior": "elder", "snr": "elder", "sr": "elder", "junior": "younger", "jnr": "younger", "jr": "younger"}
#: Nickname -> given names it is short for.
NICKNAMES = {
    "abby": "abigail", "alec": "alexander", "alex": "alexander", "sandy": "alexander", "bea": "beatrice", "trixie": "beatrice", "ben": "benjamin", "cathy": "catherine", "kate": "catherine",
    "kitty": "catherine", "chris": "christopher", "kit": "christopher", "dan": "daniel", "danny": "daniel", "dot": "dorothy", "dolly": "dorothy", "ed": "edward", "eddie": "edward", "ned": "edward",
    "ted": "edward theodore", "teddy": "theodore edward", "bess": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "liza": "elizabeth", "lizzie": "elizabeth", "eliza": "elizabeth", "fanny": "frances",
    "fran": "frances", "fred": "frederick", "freddie": "frederick", "greg": "gregory", "gwen": "gwendolyn", "hattie": "harriet", "harry": "henry", "hal": "henry", "hank": "henry", "ike": "isaac",
    "bella": "isabella", "izzy": "isabella", "jon": "jonathan", "josie": "josephine", "jo": "josephine", "ken": "kenneth", "kenny": "kenneth", "larry": "lawrence", "cindy": "lucinda", "lucy": "lucinda",
    "meg": "margaret", "peggy": "margaret", "maggie": "margaret", "matt": "matthew", "nat": "nathaniel", "nate": "nathaniel", "nick": "nicholas", "ollie": "oliver", "paddy": "patrick", "pat": "patrick",
    "penny": "penelope", "becky": "rebecca", "bob": "robert", "rob": "robert", "robin": "robert", "sam": "samuel", "sue": "susannah", "susie": "susannah", "theo": "theodore", "tom": "thomas", "tommy": "thomas",
    "vicky": "victoria", "vin": "vincent", "vince": "vincent", "bill": "william", "will": "william", "billy": "william", "winnie": "winifred", "zack": "zachary", "zach": "zachary",
}
GIVEN = sorted({g for names in NICKNAMES.values() for g in names.split()})
FIXED = {*TITLES, *BODY_WORDS, *PLACE_WORDS, *GENERATIONS, *GIVEN, *NICKNAMES}
DIGITS = str.maketrans("01358@$", "oiebsas".replace("i", "l"))
#: A token may be a misspelling of one in at least TIMES as many names, or OFTEN as many if it stands in more than RARE names.
RARE, TIMES, OFTEN = 3, 2.5, 15
#: Queries of a shard that one task walks; a shard with more of them stands in as many cells as it takes.
SHARD_QUERIES = 20_000
#: A token is a body's word if it stands in 'X of Y' with at least so many Y.
BODY_NAMES = 5
#: A token is a title if it stands before at least so many different names that also stand without it, and before others no more often.
TITLED_NAMES = 5


def tokens_of(name: str) -> list[str]:
    """Lower-case words without accents, hyphens and possessives, look-alike digits read as letters; 'Last, First' turned round."""
    text = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).lower()
    text = re.sub(r"['’]s\b", "", text.replace("&", " and "))
    text = re.sub(r"^\s*the\.(?=\s)", "theo", text)  # a short given name, not the article
    text = re.sub(r"\bof s\.? (?=\w)", "of saint ", text)
    text = re.sub(r"(?<=\w)[-‐‑](?=\w)", "", text)
    words = lambda part: [w.translate(DIGITS) if re.search(r"[^\W\d_]", w) else w for w in re.findall(r"[^\W_]+(?:[@$][^\W_]+)*|[@$][^\W_]+", part)]
    head, *tails = [words(p) for p in text.split(",")]
    tail = [w for t in tails for w in t]
    if tail and all(w in TITLES for w in tail):
        return tail + head
    return [w for w in tail if w not in GENERATIONS and w != "the"] + head + [w for w in tail if w in GENERATIONS]


def allowed(length: int) -> int:
    """Edits by which a token of this length may be misspelt."""
    return 0 if length < 4 else 1 if length < 7 else 2


class Trie:
    """Words of a shard; ``near`` runs the Levenshtein automaton of a word (with transpositions) down the trie."""

    def __init__(self):
        self.root: dict = {}

    def add(self, word: str) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = word

    def near(self, word: str, k: int) -> list[tuple[str, int]]:
        """(neighbour, distance) within k edits. A state of the automaton is the row of distances to the prefixes of ``word`` that are
        at most k longer or shorter than the path: others are out of reach, however long the word is."""
        n, out, far = len(word), [], k + 1
        band = range(2 * k + 1)
        stack = [(self.root, 0, "", [j - k if 0 <= j - k <= n else far for j in band], None)]
        while stack:
            node, depth, last, row, before = stack.pop()
            if "" in node and 0 <= n - depth + k <= 2 * k and row[n - depth + k] <= k:
                out.append((node[""], row[n - depth + k]))
            for c, child in node.items():
                if not c:
                    continue
                new = []
                for t in band:
                    j = depth + 1 - k + t
                    if j < 0 or j > n:
                        new.append(far)
                        continue
                    d = row[t + 1] + 1 if t < 2 * k else far
                    if j:
                        d = min(d, row[t] + (word[j - 1] != c), new[t - 1] + 1 if t else far)
                        if before is not None and j > 1 and c == word[j - 2] and last == word[j - 1]:
                            d = min(d, before[t] + 1)
                    new.append(d)
                if min(new) <= k or min(row) <= k - 1:
                    stack.append((child, depth + 1, c, new, row))
        return out


def _parts(length: int) -> list[tuple[int, int]]:
    """(begin, size) of the segments of a word: one more than the edits allowed for its length."""
    n = allowed(length) + 1
    sizes = [length // n + (i >= n - length % n) for i in range(n)]
    return [(sum(sizes[:i]), sizes[i]) for i in range(n)]


def index_shards(word: str) -> list[str]:
    """The shards that hold a word: its length, and each of its segments.

    An edit breaks one segment, but letters that change places over a border break two. So a segment also stands for itself with
    its first, its last or both letters taken from beyond the border: then one segment is always left whole.
    """
    parts, out = _parts(len(word)), set()
    for i, (p, n) in enumerate(parts):
        firsts = [word[p], word[p - 1]] if i else [word[p]]
        lasts = [word[p + n - 1], word[p + n]] if i + 1 < len(parts) else [word[p + n - 1]]
        for a in firsts:
            for z in lasts:
                if n > 1:
                    out.add(f"{len(word)}/{i}/{a}{word[p + 1 : p + n - 1]}{z}")
                else:
                    out |= {f"{len(word)}/{i}/{a}", f"{len(word)}/{i}/{z}"}
    return sorted(out)


def query_shards(word: str) -> list[str]:
    """The shards in which words within the allowed edits of ``word`` can stand: one segment is left whole, shifted by no more than the edits."""
    out = set()
    for length in range(max(4, len(word) - 2), len(word) + 3):
        shift, most = len(word) - length, allowed(length)
        for i, (p, n) in enumerate(_parts(length) if abs(shift) <= most else ()):
            for at in range(p - (most - shift) // 2, p + (most + shift) // 2 + 1):
                if at >= 0 and at + n <= len(word):
                    out.add(f"{length}/{i}/{word[at : at + n]}")
    return sorted(out)


def trie_join(queries: DataFrame, words: DataFrame) -> DataFrame:
    """(query, word, distance): for each of ``queries.query`` the ``words.word`` within the edits allowed for its length.

    Shards are spread by Spark; a task takes its shards one after another, first the words of a shard, then its queries in a stream.
    The queries of a shard with very many are dealt to cells, each of which holds the words of the shard.
    """
    index = words.select(F.explode(F.udf(index_shards, T.ArrayType(T.StringType()), useArrow=True)("word")).alias("shard"), F.lit(0).alias("side"), F.col("word").alias("token"))
    asked = queries.select(F.explode(F.udf(query_shards, T.ArrayType(T.StringType()), useArrow=True)("query")).alias("shard"), F.lit(1).alias("side"), F.col("query").alias("token"))
    asked = asked.join(index.select("shard").distinct(), "shard", "left_semi")
    hot = cut_lineage(asked.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > SHARD_QUERIES).select("shard", F.ceil(F.col("n") / SHARD_QUERIES).cast("int").alias("cells")))
    cells = F.coalesce("cells", F.lit(1))
    index = index.join(hot, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0), cells - 1)).alias("cell"), "side", "token")
    rows = index.unionByName(asked.join(hot, "shard", "left").select("shard", F.pmod(F.xxhash64("token"), cells).cast("int").alias("cell"), "side", "token"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, trie = None, Trie()
        for batch in batches:
            out = []
            for key, cell, side, token in zip(batch.shard, batch.cell, batch.side, batch.token):
                if (key, cell) != shard:
                    shard, trie = (key, cell), Trie()
                if side == 0:
                    trie.add(token)
                elif trie.root:
                    out += [(token, w, d) for w, d in trie.near(token, 2) if w != token and d <= min(allowed(len(w)), allowed(len(token) + 1))]
            yield pd.DataFrame(out, columns=["query", "word", "distance"])

    found = rows.repartition(partitions(queries.sparkSession), "shard", "cell").sortWithinPartitions("shard", "cell", "side").mapInPandas(run, "query string, word string, distance int")
    return found.dropDuplicates(["query", "word"])


def body_word(token: str, first: bool) -> str:
    """A short word of a body's name put right, if it is one edit from words of one meaning; else as it stands."""
    if token in FIXED or not 2 <= len(token) <= 4:
        return token
    trie = Trie()
    for w in BODY_WORDS:
        trie.add(w)
    near = sorted({w for w, d in trie.near(token, 1)}, key=lambda w: (bool(BODY_WORDS[w]) != first, len(w), w))
    near = [w for w in near if bool(BODY_WORDS[w]) == bool(BODY_WORDS[near[0]])]
    return near[0] if near and len({BODY_WORDS[w] for w in near}) == 1 else token


def parsed(tokens: list[str], given: list[bool], titles: frozenset[str] = frozenset(), bodies: dict[str, str] | None = None) -> tuple[str, str, str, str]:
    """(kind, family or body name, given name as written, generation) of matched tokens; kind '' for places, amounts and others.

    A person's name of other than two tokens, besides ``titles`` and those of the fixed list, is of kind 'name' and goes by its sorted tokens.
    ``bodies``: learned words of bodies and their short forms, and what they stand for."""
    none, bodies = ("", "", "", ""), bodies or {}
    while len(tokens) > 2 and tokens[0] == "the":
        tokens, given = tokens[1:], given[1:]
    if len(tokens) < 2 or tokens[0] in NUMBERS or tokens[0].isdigit():
        return none
    if len(tokens) > 2 and any(t in BODY_WORDS for t in tokens):
        tokens = [body_word(t, i == 0) for i, t in enumerate(tokens)]
    kinds = {BODY_WORDS[t] for t in tokens if BODY_WORDS.get(t)}
    core = [(t, g) for i, (t, g) in enumerate(zip(tokens, given)) if t not in BODY_WORDS or (len(tokens) == 2 and t == "the" and not i)]
    if not kinds - {"saint", "free"} and len(core) == 1:  # one letter of a given name may look like a body word
        kinds, core = set(), list(zip(tokens, given))
    kinds -= {"saint"} if len(core) > 1 else set()
    if kinds & BODY_KINDS and len(core) == 1 and len(kinds) <= 3:
        kinds -= {"sons", "saint", "lantern", "weavers"} if kinds & (BODY_KINDS - {"company", "mining"}) else set()
        return "body " + " ".join(sorted(kinds - ({"company"} if kinds & {"mining", "free"} else set()))), core[0][0], "", ""
    if (tokens[0] in PLACE_WORDS or tokens[-1] in PLACE_WORDS) and not (len(tokens) == 2 and tokens[0] in GIVEN):
        return none
    if len(core) == 2 and len(tokens) == 3 and tokens[1] == "of":
        return "body " + bodies.get(tokens[0], tokens[0]), tokens[2], "", ""
    if len(tokens) == 2 and (tokens[0] in bodies) != (tokens[1] in bodies):  # the same without 'of', in either order
        word, other = (0, 1) if tokens[0] in bodies else (1, 0)
        if not given[other]:
            return "body " + bodies[tokens[word]], tokens[other], "", ""
    generation = next((GENERATIONS[t] for t, _ in core if t in GENERATIONS), "")
    person = [(t, g) for t, g in core if t not in GENERATIONS]
    if len(person) > 2:
        person = [(t, g) for t, g in person if t not in TITLES and t not in titles]
    if kinds or len(person) < 2:
        return none
    if len(person) > 2:  # another shape: the same tokens in any order are one entity
        return "name", " ".join(sorted(t for t, _ in person)), "", generation
    (a, given_a), (b, given_b) = person
    if not given_a and (given_b or len(b) <= 3 < len(a)):
        a, b = b, a
    return "person", b, a, generation


def body_words(full: DataFrame) -> DataFrame:
    """(matched, body): words of bodies in the corpus, learned from names 'X of Y' (``full.m``, tokens), and what they stand for.

    X is a body's word if it stands before many Y. A shorter X is its short form if it begins alike, its letters stand in the
    word in their order, and at least half of its Y are Y of the word; of several words that with the most of them.
    """
    of = full.filter((F.size("m") == 3) & (F.col("m")[1] == "of") & ~F.col("m")[0].isin(*sorted(FIXED)) & F.col("m")[0].rlike(r"^\p{L}{2,}$"))
    of = cut_lineage(of.select(F.col("m")[0].alias("x"), F.col("m")[2].alias("y")).distinct())
    counted = of.groupBy("x").agg(F.count("*").alias("n"))
    words = counted.filter(F.col("n") >= BODY_NAMES).select(F.col("x").alias("body"))
    long = of.join(words, of["x"] == F.col("body"), "left_semi").select(F.col("x").alias("body"), "y", F.substring("x", 1, 1).alias("initial"))
    shared = of.withColumn("initial", F.substring("x", 1, 1)).join(long, ["y", "initial"]).filter((F.length("x") < F.length("body")) & F.rlike("body", F.concat(F.lit("^"), F.regexp_replace("x", "(.)", "$1.*"))))
    shared = shared.groupBy("x", "body").agg(F.count("*").alias("both")).join(counted, "x").filter(2 * F.col("both") >= F.col("n"))
    short = shared.groupBy("x").agg(F.min(F.struct(-F.col("both"), "body"))["body"].alias("body"))
    own = words.join(short, words["body"] == short["x"], "left_anti").select(F.col("body").alias("matched"), "body")
    return short.select(F.col("x").alias("matched"), "body").unionByName(own)


def spellings(df: DataFrame, name_cols: tuple[str, ...] = ("subject", "object")) -> DataFrame:
    """(name, entity): every name of a person or body in ``name_cols``, exactly as it stands, with the key of its entity.

    Names of places, amounts and names of one word get no row, nor do nulls and blanks; repeated rows count once; other columns are
    ignored; an empty table gives no row. An initial or short form that fits several given names of a family is left to itself.
    Distinct names are the largest thing shuffled; tokens and families are joined by key, nothing grows on the driver.
    """
    names = df.select(F.explode(F.array(*[F.col(c).cast("string") for c in name_cols])).alias("name")).filter("name IS NOT NULL").distinct()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tokens = [tokens_of(n) for n in batch.name]
            keep = [1 < len(t) and t[0] not in NUMBERS for t in tokens]
            yield pd.DataFrame({"name": batch.name[keep], "tokens": [t for t, k in zip(tokens, keep) if k]})

    cut_names = cut_lineage(names.mapInPandas(cut, "name string, tokens array<string>"))
    token = cut_names.select("name", "tokens", F.posexplode("tokens").alias("place", "token"))
    fixed = F.col("token").isin(*sorted(FIXED))
    titled = F.try_element_at("tokens", F.lit(1)).isin(*TITLES)
    first = (F.col("place") == F.when(titled, 1).otherwise(0)) & (F.size("tokens") == F.when(titled, 3).otherwise(2))
    # Spellings that differ in case or accents only are one attestation.
    stats = token.groupBy("token").agg(F.count_distinct(F.array_join(F.array_sort("tokens"), " ")).alias("names"), F.count_if(first).alias("first"))
    stats = cut_lineage(stats.withColumn("names", F.when(fixed, F.col("names") + 1000).otherwise(F.col("names"))).withColumn("fixed", fixed))
    long = F.length("token") >= 4
    rare = stats.filter(~F.col("fixed") & long)
    anchors = stats.filter(long).select(F.col("token").alias("word")).union(df.sparkSession.createDataFrame([(w,) for w in sorted(FIXED) if len(w) >= 4], "word string")).distinct()
    near = trie_join(rare.select(F.col("token").alias("query")), anchors)
    weight = stats.select(F.col("token").alias("word"), F.col("names").alias("word_names"))
    best = (
        near.join(weight, "word", "left")
        .withColumn("word_names", F.coalesce("word_names", F.lit(1000)))
        .join(rare.select(F.col("token").alias("query"), F.col("names").alias("query_names")), "query")
        .filter(F.col("word_names") >= F.when(F.col("query_names") <= RARE, TIMES).otherwise(OFTEN) * F.col("query_names"))
        .groupBy("query")
        .agg(F.min(F.struct("distance", -F.col("word_names"), "word")).alias("m"))
        .select(F.col("query").alias("token"), F.col("m.word").alias("matched"))
    )
    known = cut_lineage(stats.join(best, "token", "left").withColumn("matched", F.coalesce("matched", "token")))
    roles = known.groupBy("matched").agg(F.sum("first").alias("first"), F.sum(F.col("names") % 1000).alias("names"))
    is_given = F.col("matched").isin(*GIVEN, *NICKNAMES) | ((F.col("first") >= 20) & (F.col("first") >= 0.5 * F.col("names")))
    matches = known.select("token", "matched").join(roles.select("matched", is_given.alias("given")), "matched")
    # Titles of the corpus: tokens before names that also stand without them.
    read = token.select("name", "place", "token").join(matches, "token")
    full = cut_lineage(read.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "matched"))), lambda x: x["matched"]).alias("m")).filter(F.size("m") <= 3).select("m").distinct())
    three = full.filter(F.size("m") == 3).select(F.col("m")[0].alias("title"), F.array_sort(F.slice("m", 2, 2)).alias("rest")).distinct()
    two = full.filter(F.size("m") == 2).select(F.array_sort("m").alias("rest"), F.lit(1).alias("alone")).distinct()
    before = three.join(two, "rest", "left").groupBy("title").agg(F.count("*").alias("n"), F.count("alone").alias("alone"))
    learned = before.filter((F.col("alone") >= TITLED_NAMES) & (2 * F.col("alone") >= F.col("n")) & ~F.col("title").isin(*sorted(FIXED))).select(F.col("title").alias("matched"), F.lit(True).alias("title"))
    matches = matches.join(learned, "matched", "left").withColumn("title", F.coalesce("title", F.lit(False)))
    matches = matches.join(body_words(full), "matched", "left")
    joined = token.select("name", "place", "token").join(matches, "token").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("place", "matched", "given", "token", "title", "body"))).alias("t"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [parsed(list(m), list(g), frozenset(x for x, y in zip(m, t) if y), {x: y for x, y in zip(m, b) if y}) for m, g, t, b in zip(batch.matched, batch.given, batch.title, batch.body)]
            yield pd.DataFrame({"name": batch.name, **{c: [o[i] for o in out] for i, c in enumerate(("kind", "family", "written", "generation"))}})

    people = joined.select("name", F.col("t.matched").alias("matched"), F.col("t.given").alias("given"), F.col("t.title").alias("title"), F.col("t.body").alias("body")).mapInPandas(parse, "name string, kind string, family string, written string, generation string")
    people = cut_lineage(people.filter("kind <> ''"))

    bodies = people.filter("kind <> 'person'").select("name", F.concat_ws("|", "kind", "family", "generation").alias("entity"))
    persons = people.filter("kind = 'person'")
    nick = F.create_map(*[F.lit(x) for pair in NICKNAMES.items() for x in pair])
    short = persons.select("family", "generation", "written").distinct()
    full = short.filter((F.length("written") > 3) & ~F.col("written").isin(*NICKNAMES)).select("family", "generation", F.col("written").alias("full"))
    # What a short form may stand for: a given name of the family that begins with it, or that it is a nickname of.
    meant = F.split(F.try_element_at(nick, F.col("written")), " ")
    partial = short.filter((F.length("written") <= 3) | F.col("written").isin(*NICKNAMES))
    fits = F.array_contains(meant, F.col("full")) | (F.try_element_at(nick, F.col("written")).isNull() & F.col("full").startswith(F.col("written")))
    starts = (F.length("written") <= 3) & F.col("full").startswith(F.col("written"))
    options = partial.join(full, ["family", "generation"]).withColumn("by_name", F.coalesce(fits, F.lit(False))).filter(F.col("by_name") | starts)
    chosen = options.groupBy("family", "generation", "written").agg(F.collect_set(F.when(F.col("by_name"), F.col("full"))).alias("named"), F.collect_set("full").alias("any"))
    chosen = chosen.select("family", "generation", "written", F.when(F.size("named") == 1, F.col("named")[0]).when((F.size("named") == 0) & (F.size("any") == 1), F.col("any")[0]).alias("resolved"))
    # A nickname whose given name is not in the family stands for its first meaning.
    own = F.when(F.try_element_at(nick, F.col("written")).isNotNull(), F.split(F.try_element_at(nick, F.col("written")), " ")[0]).otherwise(F.col("written"))
    persons = persons.join(chosen, ["family", "generation", "written"], "left").withColumn("given", F.coalesce("resolved", own))
    return bodies.unionByName(persons.select("name", F.concat_ws("|", F.lit("person"), "family", "given", "generation").alias("entity")))


def spelling_pairs(df: DataFrame, name_cols: tuple[str, ...] = ("subject", "object")) -> DataFrame:
    """``name_a`` < ``name_b``: two different spellings of one entity; every pair of an entity's spellings."""
    found = cut_lineage(spellings(df, name_cols))
    return pairs_within(found, "entity", "name")
