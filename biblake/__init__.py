"""Analytics over corpora of scholarly documents, declared as Spark plans."""
