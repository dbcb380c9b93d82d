"""Parameters of the queries over the fixture tables, shared with their SQL twins."""

#: Ids of a direct shard, neighbours in a shard's graph and in a merged one, and fixed centres.
SHARD, DEGREE, MERGED, CENTRES = 100, 8, 6, 8
#: Shards of a vector, also under the running average, the bound of distances, and places of all shards for each vector under each rule.
REPLICAS, AVERAGED, EPSILON = 3, 2, 1.1
ROOM = {"two_round": 1.5, "nonselective": 2.5, "running_avg": 2.0}
#: A pool that holds every vector of a fixture, and vectors of the layers of a shard of 250.
FULL_POOL, LAYER_SIZES = 1 << 20, [250, 60, 15]
PLUS_PLUS, TASK_CAPACITY = 4, 60_000_000
