"""rosterlake: class-booking analytics as Spark DataFrame operators.

Subpackages: ``sources`` (schemas, loaders, adapter, sinks), ``functions``
(column helpers), ``operators`` (reports, lookups, search, rollups, access,
change operators, audits), ``plans`` (session settings, lineage cuts, plan
checks), ``streaming`` (micro-batch application of change requests).
"""

__version__ = "0.1.0"
