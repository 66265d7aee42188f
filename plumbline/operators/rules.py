"""Rules that turn a question and its answer into a statement, as one expression.

Each rule is a function of two columns (lower-case question without its mark, normalised answer) that
gives a caption, or null where it has nothing to say. The first rule with a caption wins. The whole
engine is a ``coalesce`` over the ordered list, so it runs inside code generation on any number of rows,
and in a stream as well as in a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as t

Rule = tuple[str, Callable[[Column, Column], Column]]
_say = t._sentence


def _matched(question: Column, pattern: str, caption: Callable[..., Column]) -> Column:
    """The caption made from the pattern's groups (stripped), or null."""
    groups = [F.regexp_extract(question, pattern, k + 1) for k in range(pattern.replace("(?:", "").count("("))]
    return F.when(F.rlike(question, F.lit(pattern)), caption(*groups))


def _yes(answer: Column) -> Column:
    return answer.isin(*t.YES)


def _no(answer: Column) -> Column:
    return answer.isin(*t.NO)


def _be(question: Column) -> Column:
    return F.when(F.contains(question, F.lit(" are ")), "are").otherwise("is")


# Fixed values that results depend on: the rules' names and order, their patterns and their sentences.


def what_color(q: Column, a: Column) -> Column:
    return _matched(q, r"^what color(?:s)? (?:is|are) (?:the )?(.+)$", lambda x: _say("The ", t.strip(x), " ", _be(q), " ", a, "."))


def how_many(q: Column, a: Column) -> Column:
    def caption(x: Column) -> Column:
        x = t.strip(x)
        return (
            F.when(_no(a) | (a == "zero"), _say("There are no ", x, "."))
            .when(a == "one", _say("There is one ", x, "."))
            .otherwise(_say("There are ", a, " ", x, "."))
        )

    return _matched(q, r"^how many (.+?)(?: are there| is there| are in| is in| in .+| on .+)?$", caption)


def what_is_doing(q: Column, a: Column) -> Column:
    return _matched(q, r"^what is (?:the )?(.+?) doing$", lambda x: _say("The ", t.strip(x), " is ", a, "."))


def what_kind_type(q: Column, a: Column) -> Column:
    def caption(x: Column) -> Column:
        noun = t.with_article(a)
        return (
            F.when(F.rlike(q, F.lit("this|that")), _say("This is ", noun, "."))
            .when(F.rlike(q, F.lit("these|those")), _say("These are ", noun, "."))
            .otherwise(_say("The ", t.strip(x), " is ", noun, "."))
        )

    return _matched(q, r"^what (?:kind|type) of (.+?)(?: is this| are these| is that| are those| is in .+)?$", caption)


def where(q: Column, a: Column) -> Column:
    return _matched(q, r"^where (?:is|are) (?:the )?(.+)$", lambda x: _say("The ", t.strip(x), " ", _be(q), " ", a, "."))


def who(q: Column, a: Column) -> Column:
    return _matched(q, r"^who (?:is|are) (.+)$", lambda x: _say(t.capitalized(a), " ", _be(q), " ", t.strip(x), "."))


def which(q: Column, a: Column) -> Column:
    return _matched(q, r"^which (.+)$", lambda x: _say("The ", t.strip(x), " is ", a, "."))


def _existence(a: Column, x: Column, be: str, thing: Column, other: Column) -> Column:
    return (
        F.when(_yes(a), _say(f"There {be} ", thing, "."))
        .when(_no(a), _say(f"There {be} no ", x, "."))
        .otherwise(_say(f"There {be} ", other, " ", x, "."))
    )


def is_there(q: Column, a: Column) -> Column:
    return _matched(q, r"^is there (?:a|an) (.+)$", lambda x: _existence(a, t.strip(x), "is", t.with_article(t.strip(x)), t.with_article(a)))


def are_there(q: Column, a: Column) -> Column:
    return _matched(q, r"^are there (?:any )?(.+)$", lambda x: _existence(a, t.strip(x), "are", t.strip(x), a))


def is_are_yesno(q: Column, a: Column) -> Column:
    """Statements from yes/no questions; other answers, and can/could, have none."""

    def caption(aux: Column, rest: Column) -> Column:
        rest = t.strip(rest)
        shape = r"^(this|that|these|those)\s+(.+)$"
        pointed = aux.isin("is", "was") & F.rlike(rest, F.lit(shape))
        this = _say(t.capitalized(F.regexp_extract(rest, shape, 1)), " is ", F.regexp_extract(rest, shape, 2), ".")
        subject, predicate = t.subject_and_rest(rest)
        be = F.when(aux.isin("are", "were"), "are").otherwise("is")
        plain = _say("The ", F.regexp_replace(subject, "^the ", ""), " ", predicate, ".")
        fact = F.when(pointed, this).when(aux.isin("is", "are", "was", "were"), t.about_subject(subject, predicate, be)).when(aux.isin("does", "do", "did"), plain)
        return F.when(_yes(a), fact).when(_no(a), t.negated(fact))

    return _matched(q, r"^(is|are|was|were|does|do|did|can|could) (.+)$", caption)


def what_brand_sport(q: Column, a: Column) -> Column:
    return _matched(q, r"^what (brand|sport|room|animal|vehicle|food|drink) (.+)$", lambda kind, x: _say("The ", kind, " ", t.strip(x), " is ", a, "."))


def what_is(q: Column, a: Column) -> Column:
    return _matched(
        q, r"^what is (?:the )?(.+?)(?: on .+| in .+| near .+)?$", lambda x: F.when(~a.isin(*t.YES, *t.NO), _say("The ", t.strip(x), " is ", a, "."))
    )


def fallback(q: Column, a: Column) -> Column:
    head = t.capitalized(t.without_question_mark(q))
    return F.when(_yes(a), _say(head, " — yes.")).when(_no(a), _say(head, " — no.")).otherwise(_say(head, " The answer is ", a, "."))


#: Specific rules first; add your own (name, builder) anywhere in a copy of this list.
RULES: list[Rule] = [
    (f.__name__, f)
    for f in (what_color, how_many, what_is_doing, what_kind_type, where, who, which, is_there, are_there, is_are_yesno, what_brand_sport, what_is)
]


def with_captions(df: DataFrame, question: str = "question", answer: str = "answer", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``df`` with caption and rule: of the first rule that has a caption, else of the fallback.

    Question and answer are normalised in a projection of their own, and each rule is a column of the
    next one, so that no regular expression is repeated in the final choice. All are narrow.
    """
    plain = df.withColumns({"_q": F.lower(t.without_question_mark(F.col(question))), "_a": t.normalized_answer(F.col(answer))})
    q, a = F.col("_q"), F.col("_a")
    tried = plain.withColumns({f"_{name}": build(q, a) for name, build in rules} | {"_fallback": fallback(q, a)})
    said = [(name, F.when(F.col(f"_{name}") != "", F.col(f"_{name}"))) for name, _ in rules]
    caption = F.coalesce(*(c for _, c in said), F.col("_fallback"))
    rule = F.coalesce(*(F.when(c.isNotNull(), F.lit(name)) for name, c in said), F.lit("fallback"))
    return tried.select(*df.columns, caption.alias("caption"), rule.alias("rule"))


def rule_histogram(captions: DataFrame) -> DataFrame:
    """Per rule: n and its share (percent) of all captions."""
    counted = captions.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("rule", "n", (F.lit(100.0) * F.col("n") / F.col("total")).alias("percent"))
