"""How many rows the joins of an action made."""


def most_joined(spark, action):
    """The most rows that any one join handed on."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before = store.executionsCount()
    out = action()
    bus.waitUntilEmpty()
    ran, most = store.executionsList(), 0
    for e in (ran.apply(i).executionId() for i in range(before, ran.size())):
        nodes, values = store.planGraph(e).allNodes(), store.executionMetrics(e)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if "Join" in node.name():
                for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return out, most
