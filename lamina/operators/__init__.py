"""Set operators over manifests, history, refs and blobs, as DataFrame plans."""
