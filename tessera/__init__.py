"""tessera: research-corpus analytics as Spark DataFrame operators.

Every operator is a ``DataFrame -> DataFrame`` function (composable with
``DataFrame.transform``); none of them triggers an action or collects to
the driver.  Sub-packages:

* ``sources``   – table readers, response parsing, page adapter, sinks
* ``functions`` – Column-level helpers (domain, truncation, tokenizer) and SQL functions
* ``operators`` – batch operators grouped by workflow stage
* ``streaming`` – Structured Streaming forms of the transcript operators
* ``plans``     – registered queries over the driver tables and their DuckDB oracles
"""

__version__ = "0.1.0"
