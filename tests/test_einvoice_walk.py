"""The walk over an e-invoice's elements, and what Spark can compile of its writer."""

from pyspark.sql import functions as F

from concordat.operators import einvoice
from concordat.sources import readers


def test_places_are_kept_and_bare_leaves_skipped():
    xml = "<Invoice xmlns='u'><ID>1</ID><Note><ID>2</ID></Note><InvoiceLine><ID>3</ID></InvoiceLine><InvoiceLine/><TaxTotal><TaxAmount> 5 </TaxAmount><TaxSubtotal/></TaxTotal></Invoice>"
    known = readers.Place(())
    first = readers.read_einvoice(xml, known)
    assert (first["number"], first["tax"], first["n_lines"], first["n_rates"]) == ("1", "5", 2, 1)
    root = known.at("{u}Invoice")
    assert readers.read_einvoice(xml, known) == first and known.at("{u}Invoice") is root


def test_empty_content_needs_no_lambda(spark):
    d = spark.createDataFrame([("",), ("a",), (None,)], "s string").select(einvoice.content(F.col("s")).alias("c"))
    assert "lambda" not in d._jdf.queryExecution().analyzed().toString()
    assert [r.c for r in d.collect()] == [None, "a", None]
