"""quillgraph.plans"""
