"""Spark jobs over crawled public notices: extraction, ingest, matching, coverage."""

from pyspark import cloudpickle

from noticeflow.functions import folding, text, urls
from noticeflow.operators import alerts, audit, html
from noticeflow.sources import readers
from noticeflow.streaming import buckets

# Helpers that run inside Python tasks travel with the task, so executors need no
# installed copy of this package.
for _module in (folding, text, urls, html, alerts, audit, readers, buckets):
    cloudpickle.register_pickle_by_value(_module)
