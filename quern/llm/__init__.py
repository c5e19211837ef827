"""Operators of training-data pipelines. Nothing else in quern imports this subpackage."""
