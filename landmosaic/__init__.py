"""Land-cover mosaics, habitat graphs and corpus preparation as Spark jobs."""
