"""lorequarry: a Spark-native engine for archives of documents.

Ingest, clean, chunk, embed, link and question a document archive with DataFrame plans.
``lorequarry.llm`` holds the operators for training data; nothing else in the library imports it.
"""
