"""quillgraph.sources"""
