"""factloom: evidence tables over text corpora, as Spark DataFrame operators.

Sub-packages
    sources    reading corpora, snapshots and logs; adapters from star-schema tables
    functions  Column helpers and skew-safe building blocks
    operators  DataFrame -> DataFrame operators (extract, derive, ask, verify, review, investigate)
    plans      end-to-end compositions of the operators
    streaming  the same jobs over change streams
    queries    named queries with the SQL that states the expected result
"""

__version__ = "0.1.0"
