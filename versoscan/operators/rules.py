"""Rule categories as tables: presets, reading, validation, inheritance and the texts sent with them.

A ruleset is a handful of rows, so the tables are built on the driver from a few kilobytes and broadcast in joins.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versoscan.functions.numbering import numbered

SCHEMA = "pos int, name string, enabled boolean, scope string, severity string, threshold double, description string, levels array<string>, levels_document array<string>, locate string, locate_threshold double, is_set array<string>"
FIELDS = ["enabled", "scope", "severity", "threshold", "description", "levels", "levels_document", "locate", "locate_threshold"]
DEFAULTS = {"enabled": True, "scope": "block", "severity": "warning", "threshold": 1.5, "description": "", "levels": [], "levels_document": None, "locate": None, "locate_threshold": 0.6}

# fixed values: the words that every sentence question must hold, and the clause added to every scoring instruction
CONTRACT_WORDS = ("引用", "著者自身の記述", "ルール定義", "説明例")
AUTHOR_CLAUSE = " 評価対象は著者自身の記述のみとし、引用・悪文の説明例・ルール定義の中の文は採点対象としない。"

_OWN = "引用・ルール定義・悪い説明例ではなく、著者自身の記述である"


def _category(name: str, what: str, sentence: str | None = None, **fields: object) -> dict:
    """A category in three levels, with a question for sentences unless the block as a whole is at fault."""
    levels = [f"{what}に大きな問題がある", f"{what}に小さな問題が残る", f"{what}に問題がない"]
    out = {"name": name, "description": f"{what}を評価する", "levels": levels}
    return out | ({"locate": f"この文は{sentence}。かつ{_OWN}"} if sentence else {}) | fields


# fixed values: names, scopes, thresholds and inheritance of the presets; the texts are our own
PRESETS: dict[str, dict] = {
    "base": {
        "categories": [
            _category("structure", "段落と見出しの構成", "話題を示さない先頭文か、内容の分からない見出しである"),
            _category("clarity", "指示語と術語の明確さ", "指すものが決まらない語を含む"),
            _category("concision", "文章の簡潔さ", "同じことの繰り返しか回りくどい言い方である", scope="both", levels_document=["節どうしで同じ主張が繰り返される", "一部の節が重なる", "節ごとに役割が違う"]),
            _category("voice", "主語と動作の書き方", "だれの動作か分からない"),
            _category("naturalness", "日本語としての自然さ", "翻訳調で不自然である"),
            _category("anglicism", "外来語の使い方", "日本語で言える英単語を使っている"),
            _category("substance", "内容のある言い方", "予告や総括だけで何も述べていない"),
            _category("consistency", "文書全体の表記と文体の統一", "ほかの箇所と表記や文体が違う", scope="document"),
        ]
    },
    "tech-doc": {
        "extends": "base",
        "categories": [
            _category("rigor", "断定と推量の使い分け", "根拠のない断定である"),
            _category("reader_load", "読み手の記憶への負担", "後で使わない固有名を含む"),
            _category("restraint", "演出の控えめさ", "修辞疑問か決め台詞である"),
        ],
    },
    "blog": {
        "extends": "base",
        "categories": [
            {"name": "voice", "threshold": 1.0},
            _category("restraint", "演出の控えめさ", "修辞疑問か決め台詞である"),
            _category("honesty", "確かめたことと推量の区別", "確かめていないことを確かめたように書いている"),
        ],
    },
}


def category_rows(data: dict) -> list[tuple]:
    """Rows of SCHEMA for a ruleset as read from a file; ``is_set`` names the fields it gives."""
    rows = []
    for pos, c in enumerate(data.get("categories") or []):
        rows.append((pos, c["name"], *(c.get(f, DEFAULTS[f]) for f in FIELDS), [f for f in FIELDS if f in c]))
    return [tuple(float(v) if i in (5, 10) and v is not None else v for i, v in enumerate(r)) for r in rows]


def categories(spark: SparkSession, data: dict) -> DataFrame:
    return spark.createDataFrame(category_rows(data), SCHEMA)


def load_ruleset(source: str, base_dir: Path | None = None) -> dict:
    """A preset by name, or a JSON or YAML file, relative files first."""
    path = (base_dir or Path()) / source
    if not path.suffix and not path.exists():
        path = path.with_suffix(".yaml")
    if path.is_file():
        text = path.read_text(encoding="utf-8")
        if path.suffix == ".json":
            data = json.loads(text)
        else:
            import yaml

            data = yaml.safe_load(text) or {}
        return data | {"_dir": path.resolve().parent, "_id": str(path.resolve())}
    if source in PRESETS:
        return PRESETS[source] | {"_id": source}
    raise ValueError(f"unknown ruleset: {source}")


def read_ruleset(spark: SparkSession, source: str = "base", on_top: str | None = None) -> DataFrame:
    """The categories of a ruleset after its chain of ``extends``, and of a user's own on top."""

    def resolve(name: str, base_dir: Path | None, seen: tuple[str, ...]) -> tuple[DataFrame, int]:
        data = load_ruleset(name, base_dir)
        if data["_id"] in seen:
            raise ValueError(f"ruleset extends cycle: {data['_id']}")
        own = categories(spark, data)
        parent, depth = resolve(data["extends"], data.get("_dir"), (*seen, data["_id"])) if data.get("extends") else (_ranked(own.limit(0), 0), 0)
        if problems := [f"{r['category']}.{r['field']}: {r['message']}" for r in invalid_categories(own).unionByName(patch_errors(parent, own)).collect()]:
            raise ValueError(f"invalid ruleset {name}: " + "; ".join(problems))
        return _merged(parent, own, depth + 1), depth + 1

    found, depth = resolve(source, None, ())
    if on_top:
        found = _merged(found, _placed(resolve(on_top, None, ())[0]), depth + 1)
    return _placed(found)


def _problems(*checks: tuple[str, Column, str]) -> Column:
    found = F.array(*(F.when(bad, F.struct(F.lit(field).alias("field"), F.lit(message).alias("message"))) for field, bad, message in checks))
    return F.explode(F.filter(found, lambda x: x.isNotNull()))


def invalid_categories(cats: DataFrame) -> DataFrame:
    """(category, field, message) of each broken rule about one category."""
    levels, document, t = F.size("levels"), F.size("levels_document"), F.col("locate_threshold")
    rows = cats.select(
        F.col("name").alias("category"),
        _problems(
            ("levels", (levels > 0) & ~levels.between(2, 5), "must have 2 to 5 entries"),
            ("levels_document", F.col("levels_document").isNotNull() & ~document.between(2, 5), "must have 2 to 5 entries"),
            ("locate_threshold", F.isnan(t) | ~t.between(0.0, 1.0), "must be a finite value in [0, 1]"),
            ("description", (levels > 0) & (F.col("description") == ""), "is required with levels"),
        ).alias("p"),
    )
    return rows.select("category", "p.field", "p.message")


def patch_errors(parent: DataFrame, child: DataFrame) -> DataFrame:
    """New categories must be complete; a patch may not empty the levels."""
    known = parent.select("name", F.lit(True).alias("known"))
    rows = child.join(F.broadcast(known), "name", "left")
    is_known = F.coalesce("known", F.lit(False))
    complete = (F.size("levels") > 0) & (F.col("description") != "")
    found = rows.select(F.col("name").alias("category"), _problems(("levels", is_known & F.array_contains("is_set", "levels") & (F.size("levels") == 0), "patch must not be empty"), ("name", ~is_known & ~complete, "new categories need a description and levels")).alias("p"))
    return found.select("category", "p.field", "p.message")


def _ranked(cats: DataFrame, depth: int) -> DataFrame:
    """``rank``: the ruleset that brought a category, counted from the outermost parent, and the place there."""
    return cats.withColumn("rank", F.struct(F.lit(depth).alias("depth"), F.col("pos").alias("pos")))


def _merged(parent: DataFrame, child: DataFrame, depth: int) -> DataFrame:
    """parent(.., rank) and child by name, with the rank of each category; places are not numbered yet."""
    p, c = parent.alias("p"), _ranked(child, depth).alias("c")
    joined = p.join(c, F.col("p.name") == F.col("c.name"), "full_outer")
    new = F.col("p.name").isNull()
    pick = lambda f: F.when(new | F.coalesce(F.array_contains("c.is_set", f), F.lit(False)), F.col(f"c.{f}")).otherwise(F.col(f"p.{f}")).alias(f)
    none = F.array().cast("array<string>")
    rank = F.coalesce("p.rank", "c.rank").alias("rank")
    return joined.select(F.coalesce("p.pos", "c.pos").alias("pos"), F.coalesce("p.name", "c.name").alias("name"), *(pick(f) for f in FIELDS), F.array_union(F.coalesce("p.is_set", none), F.coalesce("c.is_set", none)).alias("is_set"), rank)


def _placed(merged: DataFrame) -> DataFrame:
    """The categories with ``pos`` numbered from 0 by rank and name, from the sizes of ranges: no window over all."""
    return numbered(merged, [F.col("rank"), F.col("name")], "place").select((F.col("place") - 1).cast("int").alias("pos"), "name", *FIELDS, "is_set")


def merge_categories(parent: DataFrame, child: DataFrame) -> DataFrame:
    """By name: the child's given fields (an explicit null too) replace the parent's; the parent's order, then new ones."""
    return _placed(_merged(_ranked(parent, 0), child, 1))


def active_categories(cats: DataFrame, scope: str) -> DataFrame:
    return cats.where(F.col("enabled") & F.col("scope").isin(scope, "both"))


def rule_text_contracts(cats: DataFrame) -> DataFrame:
    """(category, word, present) for each word that a sentence question must hold."""
    words = F.explode(F.array(*(F.lit(w) for w in CONTRACT_WORDS))).alias("word")
    return cats.where("locate is not null").select(F.col("name").alias("category"), "locate", words).select("category", "word", F.col("locate").contains(F.col("word")).alias("present"))
