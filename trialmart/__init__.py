"""Analysis of coupon experiments on order data, as Spark DataFrame operators."""

__version__ = "0.1.0"
