"""Which products a text names, by a dictionary of names that grows with the products.

Names are cut into the words of their beginning; texts into the words that begin at each
place. Both meet in an equality join on bank and beginning, and the rest of the name is held
against the words that follow. Of names that hold each other at one place the longest counts,
so 'Everyday Account Plus' is no mention of 'Everyday Account'. Neither names nor texts go to
the driver, and no text meets a name that doesn't begin as it does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions import text as tx

# Words that name a kind of product and no product.
GENERIC = (
    "personal", "retail", "eligible", "banking", "bank", "account", "accounts", "chequing", "checking", "saving", "savings", "gic", "gics", "guaranteed", "investment", "certificate", "certificates", "term", "deposit",
    "deposits", "mastercard", "visa", "credit", "card", "cards", "mortgage", "mortgages", "line", "lines", "of", "loan", "loans",
)
#: Words of a name's beginning that a text must hold side by side.
BEGINNING = 2


def dictionary(products: DataFrame) -> DataFrame:
    """(bank_code, product_id, name): what each product is called, in lower case and without signs.

    A name also stands without the generic words at its end ('Everyday Savings Account' is
    'Everyday'); a name of generic words alone names no product. Several products may share one.
    """
    whole = F.array_join(tx.tokens(F.col("product_name")), " ")
    short = F.regexp_replace(whole, f"( ({'|'.join(GENERIC)}))+$", "")
    each = products.select("bank_code", "product_id", F.explode(F.array_distinct(F.array(whole, short))).alias("name"))
    return each.where((F.col("name") != "") & ~F.col("name").rlike(f"^(({'|'.join(GENERIC)})( |$))+$")).distinct()


def mentions(evidence: DataFrame, names: DataFrame) -> DataFrame:
    """(evidence_id, start, stop, name): each place where ``evidence`` (evidence_id, bank_code, text) names a product of its bank.

    Places count words from 1, ends exclusive; a mention inside a longer one is none.
    """
    forms = names.select("bank_code", "name").distinct().withColumn("words", F.split("name", " ")).withColumn("n", F.size("words"))
    forms = forms.withColumn("beginning", F.array_join(F.slice("words", 1, BEGINNING), " "))
    longest = forms.agg(F.max("n")).first()[0] or 1  # of names, not of texts: a few words
    places = evidence.where("text IS NOT NULL").select("evidence_id", "bank_code", tx.tokens(F.col("text")).alias("tokens"))
    places = places.select("evidence_id", "bank_code", F.explode(F.transform("tokens", lambda t, i: F.struct((i + 1).alias("start"), F.slice("tokens", i + 1, longest).alias("ahead")))).alias("p")).select("evidence_id", "bank_code", "p.*")
    begun = places.withColumn("beginning", F.explode(F.array(*(F.array_join(F.slice("ahead", 1, k), " ") for k in range(1, BEGINNING + 1)))))
    found = begun.join(forms, ["bank_code", "beginning"]).where(F.slice("ahead", 1, F.col("n")) == F.col("words"))
    found = found.select("evidence_id", "start", (F.col("start") + F.col("n")).alias("stop"), "name").distinct()
    own = Window.partitionBy("evidence_id").orderBy("start", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max("stop").over(own) >= F.col("stop"), F.lit(False))
    return found.withColumn("covered", covered).where("NOT covered").drop("covered")


def other_products(evidence: DataFrame, products: DataFrame) -> DataFrame:
    """(evidence_id, others, names_own, refused) of every row of ``evidence`` (evidence_id, bank_code, product_id, text).

    Evidence of a product is refused if it names another product of the bank and never its own.
    A name that the product shares is its own. Text without names, or no text, is kept.
    """
    names = dictionary(products)
    found = mentions(evidence, names).select("evidence_id", "name").distinct()
    own = names.select(F.col("bank_code").alias("b"), F.col("product_id").alias("p"), F.col("name").alias("own_name"))
    asked = found.join(evidence.select("evidence_id", "bank_code", "product_id"), "evidence_id")
    told = asked.join(own, (F.col("bank_code") == F.col("b")) & (F.col("product_id") == F.col("p")) & (F.col("name") == F.col("own_name")), "left")
    sums = told.groupBy("evidence_id").agg(F.sort_array(F.collect_set(F.when(F.col("p").isNull(), F.col("name")))).alias("others"), F.max(F.col("p").isNotNull()).alias("names_own"))
    joined = evidence.select("evidence_id").join(sums, "evidence_id", "left")
    others, named = F.coalesce("others", F.array().cast("array<string>")), F.coalesce("names_own", F.lit(False))
    return joined.select("evidence_id", others.alias("others"), named.alias("names_own"), ((F.size(others) > 0) & ~named).alias("refused"))
