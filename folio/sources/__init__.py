"""Classes of documents, their files and the stack that holds them."""
