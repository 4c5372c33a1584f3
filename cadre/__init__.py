"""cadre — workforce-performance analytics as Spark DataFrame operators.

Every operator is a function ``DataFrame -> DataFrame`` whose column names are
parameters.  The work runs as Spark SQL expressions, aggregations, joins and
windows on the executors; the driver only ever sees small metadata (a cut
point pair, a top-N list, a label set).

Sub-packages:

* ``functions``  — column expressions (trim, numeric coercion, bins, labels)
* ``sources``    — readers/writers (dirty CSV, schema JSON, model artifacts)
* ``operators``  — cleaning, rollups, roster joins, features, labels, splits,
                   encoders, evaluation, explanation, validation and scoring
* ``plans``      — the registered queries over the test tables
"""

__version__ = "0.1.0"
