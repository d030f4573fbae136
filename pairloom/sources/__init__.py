"""Reading and writing pairs, outputs, requests and responses."""
