"""passforge: evaluation analytics for generated code, as Spark DataFrame operators.

Packages: ``functions`` (column expressions), ``sources`` (landing and the run log),
``operators`` (metrics, verdicts, checks), ``plans`` (composed plans and the registered
queries), ``streaming`` (run-log streams). See README.md.
"""

__version__ = "0.1.0"
