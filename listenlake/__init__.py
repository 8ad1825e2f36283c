"""Analytics over large libraries of documents meant to be listened to, as PySpark DataFrame operators."""
