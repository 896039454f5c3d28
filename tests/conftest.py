import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tripleloom.runtime import ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='tripleloom-tests-')}")  # the folder that a cluster would share
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.codegen.wholeStage", "false").config("spark.sql.codegen.factoryMode", "NO_CODEGEN")  # compiling costs more than tiny tables
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


def rows(df):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)


EX, FOAF, SCHEMA = "http://example.com/", "http://xmlns.com/foaf/0.1/", "https://schema.org/"
NAMES = {
    "ex": EX, "foaf": FOAF, "schema": SCHEMA, "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "owl": "http://www.w3.org/2002/07/owl#",
}


def term(text):
    if text == "a":
        return f"<{NAMES['rdf']}type>"
    if text[0] in '<"_' or text[0].isdigit():
        return text
    prefix, _, local = text.partition(":")
    return f"<{NAMES[prefix]}{local}>"


def triples(text):
    """Lines of three terms with prefixed names; '_' in strings stands for a blank."""
    return [tuple(term(t).replace("_", " ") if t[0] == '"' else term(t) for t in line.split()) for line in text.strip().splitlines()]


def full(*rows_):
    return [tuple(term(x) for x in r) for r in rows_]


# The two small graphs that FIXTURES.md states.
F1 = full(
    ("ex:dave-smith", "a", "foaf:Person"),
    ("ex:dave-smith", "foaf:name", '"Dave Smith"'),
    ("ex:eric-miller", "a", "foaf:Person"),
    ("ex:eric-miller", "foaf:name", '"Eric Miller"'),
    ("ex:eric-miller", "foaf:mbox", "<mailto:e.miller123(at)example>"),
    ("ex:eric-miller", "foaf:title", '"Dr"'),
    ("ex:dave-smith", "foaf:knows", "ex:eric-miller"),
    ("ex:eric-miller", "foaf:knows", "ex:dave-smith"),
)
F2 = F1 + full(
    ("ex:w3", "a", "schema:Organization"),
    ("ex:w3", "foaf:name", '"W3"'),
    ("ex:eric-miller", "schema:worksFor", "ex:w3"),
)
