"""shelfwise: Spark-native retail pricing, demand and sentiment analytics.

Layout
------
sources    readers (CSV/JSON/one record), adapters from the supplied tables, sinks
functions  column expressions: cleaning, business rules, text
operators  DataFrame -> DataFrame operators: quality gates, features, encoders,
           splits, reports, drift, TF-IDF, ordered indexing
plans      end-to-end jobs: daily demand, price/units, sentiment, batch scoring
streaming  the same fitted, stateless transforms applied to ``readStream`` sources
"""

__version__ = "0.1.0"
