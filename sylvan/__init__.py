"""sylvan: decision-forest data work as Spark DataFrame / SQL plans.

Load and prepare tables, hold a forest as an ordinary relation of nodes,
score rows with several equivalent Spark plans, evaluate, write back and
summarise run logs.
"""

__version__ = "0.1.0"
