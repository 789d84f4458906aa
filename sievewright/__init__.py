"""DataFrame jobs on Spark for curating, matching, selecting and answering from text collections."""
