"""lexiflow: corpus linguistics as Spark DataFrame jobs.

Documents become an ordered, doubly tagged token table (part of speech and
rhetorical category); every analysis is a plain function
``DataFrame -> DataFrame`` built from Spark SQL / DataFrame operators.
"""

__version__ = "0.1.0"
