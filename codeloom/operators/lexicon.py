"""Term discovery, feature induction and dictionary coding."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.framework import Framework
from codeloom.functions.arrays import sorted_set
from codeloom.functions.stats import agreement_columns
from codeloom.session import materialise

#: Words that carry no topic, and those of them that never stand inside a term.
STOP_EN = (
    "a an the and or but nor so yet if then than as of in on at by for from to with without into onto over under about after before between through during against "
    "i you he she it we they me him her us them my your his its our their mine yours ours theirs this that these those who whom which what when where why how "
    "is am are was were be been being do does did have has had will would can could shall should may might must not no yes there here all any some each every both few more most other such only own same too very just also"
).split()
INSIDE_EN = "and or but nor so yet if then than i you he she it we they me him her us them this that these those who whom which because".split()
#: Characters that no Chinese term starts or ends with, and words that are no term in any framework.
NO_LEAD_ZH = "的了嗎呢吧啦喔耶哦嘛之麼"
NO_TAIL_ZH = "的很最都也就還卻並而把被是我你妳他她它這那其每各某另從對跟向給"
FUNCTION_ZH = tuple(dict.fromkeys((
    "我們 你們 他們 她們 它們 咱們 自己 大家 別人 人家 對方 "
    "這個 那個 這些 那些 這樣 那樣 這種 那種 這邊 那邊 這裡 那裡 哪裡 哪些 哪個 "
    "什麼 怎麼 怎樣 為何 多少 幾個 是否 "
    "沒有 有些 有的 有一 有點 有時 沒什麼 "
    "就是 但是 可是 還是 或是 於是 而是 不是 只是 也是 都是 就會 就要 才會 才能 "
    "其實 然後 所以 因為 由於 雖然 不過 而且 並且 或者 甚至 反正 反而 倒是 "
    "如果 假如 要是 除非 否則 不然 結果 總之 因此 於是乎 "
    "比如 例如 譬如 比方 之類 什麼的 等等 "
    "至於 關於 除了 之外 之後 之前 之間 以及 還有 另外 其他 其中 以外 以後 以來 "
    "比較 非常 特別 相當 十分 稍微 有點 一點 一些 很多 許多 大量 少數 部分 "
    "真的 確實 當然 一定 必須 應該 可能 或許 大概 也許 差不多 幾乎 幾乎沒有 "
    "覺得 知道 認為 以為 想說 曉得 記得 發現 看到 聽到 講到 談到 提到 說到 "
    "已經 開始 繼續 一直 常常 偶爾 現在 目前 以前 後來 最後 剛剛 等一下 馬上 "
    "裡面 外面 上面 下面 前面 後面 旁邊 中間 當中 "
    "一個 兩個 三個 一下 一樣 一起 一邊 一次 每次 這次 上次 下次 "
    "時候 情況 狀況 東西 事情 地方 方面 部份 樣子 感覺 "
    "可以 不能 不會 不要 不用 需要 想要 願意 敢說 "
    "這麼 那麼 多麼 越來越 更加 尤其"
).split()))
#: Clause ends, for the dictionary coder.
CLAUSE = r"[。！？；，、.!?;,\n]+"


def is_stop(term: Column) -> Column:
    """Terms that are a stop word."""
    return F.lower(term).isin(STOP_EN)


def clean_cjk(text: Column) -> Column:
    """Text in which everything but Han characters is an ideographic blank."""
    return F.regexp_replace(text, r"[^\x{4e00}-\x{9fff}]", "　")


def clauses(text: Column) -> Column:
    """Clauses of a text, trimmed, without empty ones; null gives an empty list."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), CLAUSE), lambda c: F.trim(c)), lambda c: c != "")


def is_fragment_zh(term: Column) -> Column:
    """Han strings that are a function word, or a piece cut at the wrong place: a bound first or last character, or a function word stuck to more."""
    some = "|".join(map(re.escape, FUNCTION_ZH))
    return term.rlike(f"^[{NO_LEAD_ZH}]|[{NO_TAIL_ZH}]$|^(?:{some})|(?:{some})$")


def words(text: Column) -> Column:
    """Sentences of lower-case words: array<array<string>>."""
    return F.transform(F.split(F.lower(text), r"[.!?;:\n]+"), lambda s: F.regexp_extract_all(s, F.lit(r"[a-z][a-z'-]*"), F.lit(0)))


def ngrams(tokens: Column, n: int) -> Column:
    """Word n-grams of an array, joined by blanks."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(1))), lambda i: i + (n - 1) <= F.size(tokens))
    return F.transform(at, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def discover_terms_en(texts: DataFrame, text: str = "text", most: int = 4, least: int = 3, pmi: float = 1.5, top: int | None = 800) -> DataFrame:
    """(term, freq, cohesion, score): words and 2..4-grams that stick together.

    cohesion = log2(p(gram) / prod p(word)) / (n - 1); score = ln(freq + 1) for words, cohesion
    * ln(freq + 1) for n-grams. n-grams never cross a sentence end, do not start or end with
    a stop word and hold no conjunction or pronoun. All n are counted in one pass with
    map-side aggregation. ``top`` is the report's length (None: all).
    """
    sents = texts.filter(F.col(text).isNotNull()).select(F.explode(words(F.col(text))).alias("w")).filter(F.size("w") > 0)
    sized = lambda n: lambda g: F.struct(F.lit(n).alias("n"), g.alias("term"))
    grams = F.concat(*[F.transform(ngrams(F.col("w"), n), sized(n)) for n in range(1, most + 1)])
    # Written once: the counts are read four times.
    counts = materialise(sents.select(F.explode(grams).alias("g")).groupBy("g.n", "g.term").agg(F.count("*").alias("freq")), "ngrams")
    uni = counts.filter("n = 1").select(F.col("term").alias("word"), F.col("freq").alias("f"))
    total = uni.agg(F.sum("f").cast("double").alias("total"))
    frequent = counts.filter(F.col("freq") >= least)
    one = frequent.filter((F.col("n") == 1) & (F.length("term") >= 2) & ~is_stop(F.col("term"))).select("term", "freq", F.lit(0.0).alias("cohesion"), F.log(F.col("freq") + 1.0).alias("score"))
    parts = F.split("term", " ")
    more = frequent.filter("n > 1").withColumn("parts", parts).filter(~is_stop(F.element_at("parts", 1)) & ~is_stop(F.element_at("parts", -1)) & ~F.arrays_overlap("parts", F.array(*[F.lit(x) for x in INSIDE_EN])))
    logs = more.select("n", "term", "freq", F.explode("parts").alias("word")).join(uni, "word").groupBy("n", "term", "freq").agg(F.sum(F.log2("f")).alias("lw"))
    # ``total`` is one row.
    scored = logs.withColumn("one", F.lit(1)).join(total.withColumn("one", F.lit(1)), "one")
    coh = (F.log2("freq") - F.log2("total") - (F.col("lw") - F.col("n") * F.log2("total"))) / (F.col("n") - 1)
    many = scored.select("term", "freq", coh.alias("cohesion")).filter(F.col("cohesion") >= pmi).withColumn("score", F.col("cohesion") * F.log(F.col("freq") + 1.0))
    out = one.unionByName(many)
    return out if top is None else out.orderBy(F.desc("score"), "term").limit(top)


def discover_terms_cjk(texts: DataFrame, text: str = "text", most: int = 6, least: int = 3, pmi: float = 1.5, entropy: float = 0.8, top: int | None = 800) -> DataFrame:
    """(term, freq, cohesion, left_entropy, right_entropy, score) of Han character strings of 2..6.

    cohesion = the least ln(p(s) / (p(left) p(right))) over all splits; entropies are those of
    the neighbouring characters (a text's edge counts as one neighbour); score = cohesion + the
    smaller entropy + ln(freq). Grams never cross other characters. Function words and
    fragments (``is_fragment_zh``) are no terms, but count as parts and neighbours of others.
    ``top`` is the report's length (None: all).
    """
    runs = texts.filter(F.col(text).isNotNull()).select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"[\x{4e00}-\x{9fff}]+"), F.lit(0))).alias("r"))
    at = lambda n: F.filter(F.sequence(F.lit(1), F.greatest(F.length("r") - (n - 1), F.lit(1))), lambda i: i + (n - 1) <= F.length("r"))
    edge = lambda c: F.when(c == "", F.lit("^")).otherwise(c)
    gram = lambda k: lambda i: F.struct(
        F.lit(k).alias("n"), F.col("r").substr(i, F.lit(k)).alias("s"), edge(F.when(i > 1, F.col("r").substr(i - 1, F.lit(1))).otherwise("")).alias("l"), edge(F.col("r").substr(i + k, F.lit(1))).alias("rt"))
    grams = F.concat(*[F.transform(at(n), gram(n)) for n in range(1, most + 1)])
    rows = materialise(runs.select(F.explode(grams).alias("g")).groupBy("g.n", "g.s", "g.l", "g.rt").agg(F.count("*").alias("c")), "grams")
    counts = rows.groupBy("n", "s").agg(F.sum("c").alias("freq"))
    total = counts.filter("n = 1").agg(F.sum("freq").cast("double").alias("total"))
    keep = counts.filter((F.col("n") > 1) & (F.col("freq") >= least) & ~is_fragment_zh(F.col("s")))

    def side(c: str, name: str) -> DataFrame:
        per = rows.join(keep.select("s"), "s", "left_semi").groupBy("s", c).agg(F.sum("c").alias("k"))
        sums = per.groupBy("s").agg(F.sum("k").cast("double").alias("t"), F.sum(F.col("k") * F.log("k")).alias("kl"))
        return sums.select("s", (F.log("t") - F.col("kl") / F.col("t")).alias(name))

    splits = keep.select("n", "s", "freq", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k")).withColumn("a", F.substring(F.col("s"), 1, F.col("k"))).withColumn("b", F.col("s").substr(F.col("k") + 1, F.col("n")))
    ca = counts.select(F.col("s").alias("a"), F.col("freq").alias("fa"))
    cb = counts.select(F.col("s").alias("b"), F.col("freq").alias("fb"))
    scored = splits.join(ca, "a").join(cb, "b").withColumn("one", F.lit(1)).join(total.withColumn("one", F.lit(1)), "one")
    coh = scored.groupBy("s", "freq").agg(F.min(F.log("freq") + F.log("total") - F.log("fa") - F.log("fb")).alias("cohesion")).filter(F.col("cohesion") >= pmi)
    out = coh.join(side("l", "left_entropy"), "s").join(side("rt", "right_entropy"), "s")
    low = F.least("left_entropy", "right_entropy")
    out = out.filter(low >= entropy).select(F.col("s").alias("term"), "freq", "cohesion", "left_entropy", "right_entropy", (F.col("cohesion") + low + F.log("freq")).alias("score"))
    return out if top is None else out.orderBy(F.desc("score"), "term").limit(top)


def with_doc_freq(induced: DataFrame, tokens: DataFrame) -> DataFrame:
    """Adds ``doc_freq``: documents (``doc_id`` of the tokens) of the code that hold the term."""
    seen = tokens.filter("doc_id is not null").select("code", "term", "doc_id").distinct().groupBy("code", "term").agg(F.count("*").alias("doc_freq"))
    return induced.join(seen, ["code", "term"], "left").fillna(0, ["doc_freq"])


def lexicon_mismatch(terms: DataFrame, frameworks: DataFrame, framework_id: str) -> DataFrame:
    """(dimension, terms): dimensions of a lexicon that the framework does not have."""
    own = frameworks.filter(F.col("framework_id") == framework_id).select("dimension")
    return terms.join(own, "dimension", "left_anti").groupBy("dimension").agg(F.count("*").alias("terms"))


def literature_terms(terms: DataFrame, works: DataFrame, least: int = 1) -> DataFrame:
    """Terms that at least ``least`` works' titles or abstracts mention, with how many: (term, works). The terms are a lexicon's."""
    hay = works.select("work_id", F.lower(F.concat_ws(" ", "title", "abstract")).alias("hay"))
    words = hay.select("work_id", "hay", F.explode(F.array_distinct(F.regexp_extract_all("hay", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("w"))
    # A term is looked for only where its first word occurs.
    t = terms.select("term").filter("trim(term) <> ''").distinct().withColumn("w", F.regexp_extract(F.lower("term"), r"[\p{L}\p{N}]+", 0))
    return words.join(t, "w").filter(F.contains("hay", F.lower("term"))).groupBy("term").agg(F.countDistinct("work_id").alias("works")).filter(F.col("works") >= least)


def log_odds(tokens: DataFrame, least: int = 3, top: int | None = 30, prior: float | None = None) -> DataFrame:
    """Log-odds with an informative Dirichlet prior: (code, term, z, log_odds, count_in, count_out).

    ``tokens``: (code, term) one row per occurrence. The prior is the whole corpus (terms of
    at least ``least`` occurrences), of strength ``prior`` (default: its size). Stop words are
    dropped after the counts, before the top.
    """
    ct = materialise(tokens.filter("code is not null and term is not null").groupBy("code", "term").agg(F.count("*").alias("count_in")), "terms")
    bg = ct.groupBy("term").agg(F.sum("count_in").alias("total")).filter(F.col("total") >= least)
    n_code = ct.join(bg.select("term"), "term", "left_semi").groupBy("code").agg(F.sum("count_in").cast("double").alias("ni"))
    whole = bg.agg(F.sum("total").cast("double").alias("big"))
    names = n_code.agg(F.collect_list(F.struct("code", "ni")).alias("codes"))
    # One row with the (few) codes and the corpus size is joined to every term: every code x term cell is wanted.
    grid = bg.withColumn("one", F.lit(1)).join(names.withColumn("one", F.lit(1)), "one").join(whole.withColumn("one", F.lit(1)), "one").select("term", "total", "big", F.explode("codes").alias("c"))
    grid = grid.select("term", "total", "big", "c.code", "c.ni").join(ct, ["code", "term"], "left").fillna(0, ["count_in"])
    a0 = F.lit(prior) if prior else F.col("big")
    alpha = a0 * (F.col("total") / F.col("big"))
    yi, yj = F.col("count_in").cast("double"), (F.col("total") - F.col("count_in")).cast("double")
    nj = F.col("big") - F.col("ni")
    num_i, den_i = yi + alpha, F.col("ni") + a0 - yi - alpha
    num_j, den_j = yj + alpha, nj + a0 - yj - alpha
    ok = F.least(num_i, den_i, num_j, den_j) > 0
    delta = F.log(num_i / den_i) - F.log(num_j / den_j)
    out = grid.filter(ok).select("code", "term", (delta / F.sqrt(1 / num_i + 1 / num_j)).alias("z"), delta.alias("log_odds"), "count_in", (F.col("total") - F.col("count_in")).alias("count_out")).filter(~is_stop(F.col("term")))
    if top is None:
        return out
    return out.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("z"), "term"))).filter(F.col("r") <= top).drop("r")


def code_tokens(texts: DataFrame, code: str, text: str) -> DataFrame:
    """(code, term): English words of the texts of each code."""
    return texts.select(F.col(code).alias("code"), F.explode(F.flatten(words(F.col(text)))).alias("term"))


def new_terms(induced: DataFrame, lexicon_terms: DataFrame, least_z: float = 2.0, most: int = 15) -> DataFrame:
    """Induced terms to add: among the first ``most`` of a code, z at least ``least_z``, not in the lexicon yet."""
    ranked = induced.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("z"), "term"))).filter((F.col("r") <= most) & (F.col("z") >= least_z))
    return ranked.join(lexicon_terms.select("code", "term").distinct(), ["code", "term"], "left_anti").drop("r")


@dataclass(frozen=True)
class Lexicon:
    """terms: (dimension, polarity or '', term); patterns: (id, dimension, polarity or '', regex)."""

    terms: tuple[tuple[str, str, str], ...]
    patterns: tuple[tuple[str, str, str, str], ...] = ()
    negators: tuple[str, ...] = ()
    intensifiers: tuple[str, ...] = ()
    pivots: tuple[str, ...] = ()
    reported: tuple[str, ...] = ()
    _: None = field(default=None, repr=False)

    def size(self) -> int:
        return len(self.terms) + len(self.patterns)


#: Fixed values of the dictionary coder's weights.
INTENSIFIED, AFTER_PIVOT, BEFORE_PIVOT = 1.5, 1.5, 0.7


class DictionaryCoder:
    """Transparent rules as a yardstick: terms and patterns weighted by what stands around them.

    A term's weight is 1, times 1.5 after an intensifier in the six characters before it,
    times 1.5 after and 0.7 before the clause's first pivot, times 0.4 in reported speech; a
    negator in the six characters before flips the polarity of two-pole frameworks. Terms
    inside longer ones do not count. Patterns weigh double; only those of the first pole flip.
    A dimension gets its heaviest polarity from 1.0 on, none on a tie; without polarity the
    dimension alone is scored.

    One automaton holds terms and modifiers; a clause is read once and everything else is
    arithmetic on the intervals found.
    """

    def __init__(self, lexicon: Lexicon, framework: Framework, reach: int = 6, pattern_weight: float = 2.0, reported_weight: float = 0.4, threshold: float = 1.0) -> None:
        self.lex, self.fw, self.reach = lexicon, framework, reach
        self.pattern_weight, self.reported_weight, self.threshold = pattern_weight, reported_weight, threshold
        self.patterns = [(re.compile(rx), (dim, pol)) for _, dim, pol, rx in lexicon.patterns]
        poles = framework.polarities
        self.other_pole = dict(zip(poles, reversed(poles))) if len(poles) == 2 else {}
        # word -> the codes it stands for, in the lexicon's order, and the roles it has as a modifier
        self.words: dict[str, tuple[list[tuple[str, str]], set[str]]] = {}
        for dim, pol, term in lexicon.terms:
            if term:
                self.words.setdefault(term, ([], set()))[0].append((dim, pol))
        for role in ("negators", "intensifiers", "pivots", "reported"):
            for word in filter(None, getattr(lexicon, role)):
                self.words.setdefault(word, ([], set()))[1].add(role)
        self._automaton: ahocorasick.Automaton | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def _found(self, clause: str) -> list[tuple[int, int, str]]:
        """(start, end, word) of every occurrence of every word."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for word in self.words:
                self._automaton.add_word(word, word)
            self._automaton.make_automaton()
        return [(last + 1 - len(word), last + 1, word) for last, word in self._automaton.iter(clause)] if self.words else []

    def _weigh(self, clause: str) -> Iterator[tuple[tuple[str, str], float]]:
        """(code, weight) of every hit of a clause."""
        found = self._found(clause)
        of = lambda role: [(a, b) for a, b, word in found if role in self.words[word][1]]
        base = self.reported_weight if of("reported") else 1.0
        turn = min((a for a, _ in of("pivots")), default=None)
        before = {role: {at for a, b in of(role) for at in range(b, a + self.reach + 1)} for role in ("negators", "intensifiers")}
        # Sweep from the left, longer words first: what ends before something seen ends lies inside it.
        reached, hits = 0, []
        for a, b, word in sorted((f for f in found if self.words[f[2]][0]), key=lambda f: (f[0], -f[1])):
            if b > reached:
                reached = b
                hits.append((a, self.words[word][0][0], INTENSIFIED if a in before["intensifiers"] else 1.0, True))
        for rx, code in self.patterns:
            if m := rx.search(clause):
                hits.append((m.start(), code, self.pattern_weight, code[1] in self.fw.polarities[:1]))
        for at, (dim, pol), weight, flips in hits:
            if flips and at in before["negators"]:
                pol = self.other_pole.get(pol, pol)
            yield (dim, pol), base * weight * (1.0 if turn is None else AFTER_PIVOT if at > turn else BEFORE_PIVOT)

    def scores(self, text: str | None) -> dict[tuple[str, str], float]:
        """Summed weights per (dimension, polarity or '')."""
        total: Counter = Counter()
        for clause in re.split(CLAUSE, text or ""):
            for code, weight in self._weigh(clause.strip()):
                total[code] += weight
        return dict(total)

    def codes(self, text: str | None) -> list[str]:
        scores, out = self.scores(text), []
        for d in self.fw.dimensions:
            own = {pol: v for (dim, pol), v in scores.items() if dim == d.id and (not self.fw.polarities or pol in self.fw.polarities)}
            if not self.fw.polarities:
                best, value = None, sum(own.values())
            else:
                best = max(own, key=own.get, default=None)
                value = own.get(best, 0.0)
                if sum(abs(v - value) < 1e-9 for v in own.values()) > 1:
                    continue
            if value >= self.threshold:
                out.append("-".join(filter(None, (d.short, best))))
        return out


def dictionary_codes(df: DataFrame, coder: DictionaryCoder | dict[str, DictionaryCoder], text: str = "text", name: str = "dictionary_codes", key: str = "framework_id") -> DataFrame:
    """Adds the dictionary coder's codes; the lexicon travels with the function (it is configuration).

    Of several coders the one under the row's ``key`` is taken; null where there is none.
    """

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for s, k in parts:
            own = [(coder.get(x) if isinstance(coder, dict) else coder) for x in k]
            yield pd.Series([c.codes(t) if c else None for c, t in zip(own, s)], dtype=object)

    return df.withColumn(name, run(F.col(text), F.col(key) if isinstance(coder, dict) else F.lit("")))


def compare_coders(rows: DataFrame, codes: list[str] | Column, a: str = "codes", b: str = "dictionary_codes", keys: Sequence[str] = ()) -> DataFrame:
    """Per code (and ``keys``; ``codes`` is then a column of the row's codes): counts of both, P, R, F1 (null unless P + R > 0) and kappa of two code arrays."""
    wanted = codes if isinstance(codes, Column) else F.array(*map(F.lit, codes))
    cells = F.transform(wanted, lambda c: F.struct(c.alias("code"), F.array_contains(sorted_set(F.col(a)), c).alias("a"), F.array_contains(sorted_set(F.col(b)), c).alias("b")))
    x = rows.select(*keys, F.explode(cells).alias("x")).select(*keys, "x.*")
    one = lambda c: F.sum(c.cast("int"))
    g = x.groupBy(*keys, "code").agg(F.count("*").alias("n"), one(F.col("a") & F.col("b")).alias("both_yes"), one(~F.col("a") & ~F.col("b")).alias("neither"), one(F.col("a") & ~F.col("b")).alias("only_a"), one(~F.col("a") & F.col("b")).alias("only_b"))
    d = lambda c: F.col(c).cast("double")
    p, r = F.try_divide(d("both_yes"), d("both_yes") + d("only_b")), F.try_divide(d("both_yes"), d("both_yes") + d("only_a"))
    k = agreement_columns(*(F.col(c) for c in ("n", "both_yes", "neither", "only_a", "only_b")))["kappa"]
    return g.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))).withColumn("kappa", k)


def audit_llm(rows: DataFrame, coder: DictionaryCoder | dict[str, DictionaryCoder], miss: float = 2.0, text: str = "text", key: str = "framework_id") -> DataFrame:
    """Codes given with dictionary score 0 (over) and dictionary scores of at least ``miss`` without the code (miss).

    Of several coders the one under the row's ``key`` (a column of the result then) is taken; without one a row cannot be audited and gives none.
    """
    keys = [key] if isinstance(coder, dict) else []

    def score(t: str | None, c: DictionaryCoder | None) -> list[dict] | None:
        return None if c is None else [{"code": c.fw.code_of(d, p or None), "score": v} for (d, p), v in c.scores(t).items() if c.fw.code_of(d, p or None)]

    @F.pandas_udf("array<struct<code:string,score:double>>")
    def scored(s: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([score(t, coder.get(x) if isinstance(coder, dict) else coder) for t, x in zip(s, k)], dtype=object)

    x = rows.withColumn("s", scored(F.col(text), F.col(key) if keys else F.lit(""))).filter("s is not null")
    given = lambda c: F.array_contains("codes", c)
    over = F.transform(F.filter("codes", lambda c: ~F.exists("s", lambda y: (y["code"] == c) & (y["score"] > 0))), lambda c: F.struct(c.alias("code"), F.lit(0.0).alias("score"), F.lit("over").alias("kind")))
    missed = F.transform(F.filter("s", lambda y: (y["score"] >= miss) & ~given(y["code"])), lambda y: F.struct(y["code"].alias("code"), y["score"].alias("score"), F.lit("miss").alias("kind")))
    return x.select(*keys, "unit_id", F.explode(F.concat(over, missed)).alias("a"), F.substring(text, 1, 120).alias("excerpt")).select(*keys, "unit_id", "a.*", "excerpt")


def vocabulary(lexicon_terms: DataFrame, discovered: DataFrame) -> DataFrame:
    """(term, source): the lexicon's terms and those discovered; a term of both is the lexicon's."""
    a = lexicon_terms.select("term").filter("term is not null").distinct().withColumn("source", F.lit("lexicon"))
    return a.unionByName(discovered.select("term").distinct().join(a.select("term"), "term", "left_anti").withColumn("source", F.lit("discovered")))


class Segmenter:
    """Words of a text by blanks, with listed terms kept whole; Han runs by longest match of the listed terms."""

    def __init__(self, terms: list[str]) -> None:
        latin = sorted({t.lower() for t in terms if t and re.search(r"[a-z]", t, re.I)}, key=lambda t: (-len(t), t))
        self.han = {t for t in terms if t and not re.search(r"[a-z]", t, re.I)}
        self.longest = max(map(len, self.han), default=1)
        listed = rf"(?<![\w'-])(?:{'|'.join(map(re.escape, latin))})(?![\w'-])|" if latin else ""
        self.words = re.compile(listed + r"[a-z][a-z'-]*|[一-鿿]+")

    def split(self, text: str | None) -> list[str]:
        out: list[str] = []
        for w in self.words.findall((text or "").lower()):
            if not ("一" <= w[0] <= "鿿"):
                out.append(w)
                continue
            i = 0
            while i < len(w):
                n = next((k for k in range(min(self.longest, len(w) - i), 1, -1) if w[i : i + k] in self.han), 1)
                out.append(w[i : i + n])
                i += n
        return out


def segment(df: DataFrame, segmenter: Segmenter, text: str = "text", name: str = "tokens") -> DataFrame:
    """Adds the segmenter's words; null text gives an empty list."""

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(segmenter.split)

    return df.withColumn(name, run(F.col(text)))
