"""Jobs made of operators: ingest, search, corpus, training, scoring, snapshots."""
