"""Model families behind one interface, on Spark ML."""
