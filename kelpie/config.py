"""Settings of a retrieval engine. Passed explicitly, never changed in place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    parent_size: int = 1500
    parent_overlap: int = 128
    child_size: int = 256
    child_overlap: int = 32
    heading_ratio: float = 1.15
    heading_length: int = 120
    ocr_below: int = 50
    vector_k: int = 8
    graph_k: int = 10
    hops: int = 3
    nodes_per_candidate: int = 5
    edges_per_candidate: int = 50
    edges_one_hop: int = 30
    triples_per_candidate: int = 5
    rrf_k: int = 60
    graph_weight: float = 0.5
    similarity: float = 0.88
    name_prefix: int = 3
    agent_rounds: int = 4
    agent_chunks: int = 3
    agent_triples: int = 8
    extract_cap: int = 3000
    rerank_cap: int = 512
    observation_cap: int = 400
    finish_cap: int = 300
    k1: float = 1.5
    b: float = 0.75
    idf_floor: float = 0.25
    token_cap: int = 4_000_000
    price_in: float = 0.15
    price_out: float = 0.60
    query_prefix: str = "Represent this sentence for searching relevant passages: "

    @property
    def lexical_k(self) -> int:
        return 2 * self.vector_k


DEFAULT = Settings()
