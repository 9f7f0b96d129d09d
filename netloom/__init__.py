"""netloom: network analysis and unsupervised learning as Spark plans."""
