import pytest

NODES = "page_id bigint, node_id int, parent_id int, sub_end int, depth int, child_no int, kind string, local_name string, attrs array<struct<name:string,value:string>>, content string, endpoint_id string, k string, blob binary, url string"
#: A few correct texts in three languages, enough for small models.
SAMPLES = [
    ("en", "The old harbour was rebuilt by the town council before the road was built. Every visitor knows the river museum and the weather station."),
    ("en", "According to the report, the small bakery belongs to the school. The keeper’s notebook describes the long summer at the edge of town."),
    ("de", "Die alte Brücke überragt das Rathaus seit fast hundert Jahren. Für viele Gäste zählt das Fest der Müller, während die Fähre öffnet."),
    ("de", "Außerdem heißt es: das Gewächshaus schützt eine grüne Tür. Die Bücherei gehörte früher zu der Gärtnerei am Markt."),
    ("fr", "Le marché d’hiver accompagne le théâtre d’été. La forêt voisine protège une échelle empruntée depuis près d’un siècle."),
    ("fr", "À la surprise générale, l’école du village a changé la fête d’automne. Le café près de l’écluse révèle peu à peu la route du sel."),
]


@pytest.fixture(scope="session")
def lang_samples(spark):
    return spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(SAMPLES * 3)] + [(99, None, "x"), (100, "en", None)], "sample_id int, lang string, text string")


@pytest.fixture(scope="session")
def node_table(spark):
    """Node tables from html by page id, with columns whose names clash with inner ones."""
    from pyspark.sql import functions as F

    from leafspan.sources.html import parse

    def make(pages, endpoint="h.example"):
        df = parse(spark.createDataFrame(pages, "page_id bigint, html string"), columns=["node_id", "parent_id", "sub_end", "depth", "child_no", "kind", "local_name", "attrs", "content"])
        return df.withColumn("endpoint_id", F.lit(endpoint)).withColumn("k", F.lit("x")).withColumn("blob", F.lit(None).cast("binary")).withColumn("url", F.lit("clash"))

    return make


@pytest.fixture(scope="session")
def no_nodes(spark):
    return spark.createDataFrame([], NODES)


@pytest.fixture(scope="session")
def contents():
    """(page, content) of found rows, to read results by."""

    def of(found, nodes):
        return sorted((r["page_id"], r["content"]) for r in found.join(nodes.select("page_id", "node_id", "content").distinct(), ["page_id", "node_id"]).collect())

    return of
